"""Python sources as graph rows: calls with structured regions, and flows of values.

Every module is lowered on its own (mapInPandas over (path, content)) into
nodes and edges; flows between functions are then joins of arguments with
parameters, and of returns with calls, by qualified name. A call's results are
tied to the call, so that callers of one helper don't share what it returns
unless its parameter itself carries the value.

Regions: ``/fn<k>`` for a function, ``/if<n>.t`` and ``.e`` for arms,
``/loop<n>.b`` for bodies; a finally block runs in the enclosing region after
the rest. A nested function hangs off its region with ``#``. Assigning replaces
what a variable held; after arms a variable holds what any of them left.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "node_id string, node_type string, loc string, region string, ord int, scope string, method string, callee_path string, str_args array<string>, props map<string,string>, module string"
ROW_SCHEMA = f"kind string, src string, dst string, {NODE_SCHEMA}"


class Lowering:
    def __init__(self, path: str, text: str):
        self.path, self.module = path, path.removesuffix(".py").strip("/").replace("/", ".").removesuffix(".__init__")
        self.nodes: list[dict] = []
        self.edges: list[tuple[str, str]] = []
        self.order = self.blocks = 0
        self.names: dict[str, str] = {}  # local name -> dotted name
        tree = ast.parse(text)
        for n in tree.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.names[n.name] = f"{self.module}.{n.name}"
        self.region, self.scope, self.function, self.receiver = "/fn0", self.module, self.module, ""
        self.body(tree.body, {})

    # ---- rows

    def node(self, node_type: str, at: ast.AST | None, **more) -> str:
        self.order += 1
        node_id = f"{self.module}#{self.order}"
        self.nodes.append({"node_id": node_id, "node_type": node_type, "loc": f"{self.path}:{getattr(at, 'lineno', 0)}", "region": self.region, "ord": self.order, "scope": self.scope, "method": "", "callee_path": "", "str_args": [], "props": {"fn": self.function}, "module": self.module} | more)
        return node_id

    def flow(self, sources: set[str], target: str) -> None:
        self.edges += [(s, target) for s in sorted(sources) if s != target]

    # ---- statements

    def body(self, statements: list[ast.stmt], env: dict[str, set[str]]) -> None:
        for s in statements:
            self.statement(s, env)

    def inside(self, suffix: str, statements: list[ast.stmt], env: dict[str, set[str]]) -> dict[str, set[str]]:
        outer, own = self.region, dict(env)
        self.region = outer + suffix
        self.body(statements, own)
        self.region = outer
        return own

    @staticmethod
    def merge(env: dict[str, set[str]], *arms: dict[str, set[str]]) -> None:
        for name in {n for a in arms for n in a}:
            env[name] = set().union(*(a.get(name, set()) for a in arms))

    def statement(self, s: ast.stmt, env: dict[str, set[str]]) -> None:
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            base = "." * getattr(s, "level", 0) + (getattr(s, "module", "") or "")
            for a in s.names:
                full = f"{base.lstrip('.')}.{a.name}" if isinstance(s, ast.ImportFrom) else a.name
                local = a.asname or (a.name if isinstance(s, ast.ImportFrom) else a.name.split(".")[0])
                self.names[local] = full if a.asname or isinstance(s, ast.ImportFrom) else local
                self.node("code.Import", s, callee_path=full, props={"fn": self.function, "local": local, "package": full.split(".")[0]})
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.define(s, env)
        elif isinstance(s, ast.ClassDef):
            outer = self.scope, self.receiver
            self.scope, self.receiver = f"{self.scope}/{s.name}", s.name
            self.body(s.body, dict(env))
            self.scope, self.receiver = outer
        elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            value = self.value(s.value, env) if s.value is not None else set()
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                self.bind(t, value, env, isinstance(s, ast.AugAssign))
        elif isinstance(s, (ast.Return, ast.Expr)):
            value = self.value(s.value, env) if s.value is not None else set()
            if isinstance(s, ast.Return):
                self.flow(value, self.node("code.Return", s))
        elif isinstance(s, ast.If):
            self.value(s.test, env)
            self.blocks += 1
            k = self.blocks
            self.merge(env, self.inside(f"/if{k}.t", s.body, env), self.inside(f"/if{k}.e", s.orelse, env))
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            found = self.value(s.iter if hasattr(s, "iter") else s.test, env)
            own = dict(env)
            if hasattr(s, "target"):
                self.bind(s.target, found, own)
            self.blocks += 1
            k = self.blocks
            self.merge(env, env, self.inside(f"/loop{k}.b", s.body, own))
            self.body(s.orelse, env)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                value = self.value(item.context_expr, env)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, value, env)
            self.body(s.body, env)
        elif isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            self.blocks += 1
            k = self.blocks
            tried = self.inside(f"/try{k}.b", s.body + s.orelse, env)
            arms = [self.inside(f"/try{k}.h{i}", h.body, tried) for i, h in enumerate(s.handlers)]
            self.merge(env, tried, *arms)
            self.body(s.finalbody, env)
        elif isinstance(s, (ast.Assert, ast.Raise, ast.Delete)):
            for e in ast.iter_child_nodes(s):
                if isinstance(e, ast.expr) and not isinstance(s, ast.Delete):
                    self.value(e, env)
        elif isinstance(s, ast.Match):
            found = self.value(s.subject, env)
            self.blocks += 1
            arms = []
            for i, c in enumerate(s.cases):
                own = dict(env)
                for p in ast.walk(c.pattern):
                    if getattr(p, "name", None) and isinstance(p, (ast.MatchAs, ast.MatchStar)):
                        own[p.name] = found
                arms.append(self.inside(f"/if{self.blocks}.c{i}", c.body, own))
            self.merge(env, env, *arms)

    def define(self, s: ast.FunctionDef, env: dict[str, set[str]]) -> None:
        outer = self.region, self.scope, self.function
        name = ".".join(x for x in (outer[2] if outer[2] != self.module else self.module, self.receiver if outer[2] == self.module else "", s.name) if x)
        self.names.setdefault(s.name, name)
        self.blocks += 1
        self.region = f"/fn{self.blocks}" if outer[2] == self.module else f"{outer[0]}#fn{self.blocks}"
        self.scope, self.function = f"{outer[1]}/fn{self.blocks}", name
        self.node("code.Function", s, callee_path=name, props={"fn": name})
        own = dict(env)
        parameters = [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs, *(x for x in (s.args.vararg, s.args.kwarg) if x)]
        skip = 1 if self.receiver and parameters and parameters[0].arg in ("self", "cls") else 0
        for i, p in enumerate(parameters):
            own[p.arg] = {self.node("code.Param", s, callee_path=name, props={"fn": name, "index": str(i - skip), "name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else ""})}
        self.body(s.body, own)
        self.region, self.scope, self.function = outer

    def bind(self, target: ast.expr, value: set[str], env: dict[str, set[str]], add: bool = False) -> None:
        if isinstance(target, ast.Name):
            env[target.id] = value | env.get(target.id, set()) if add else value
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t, value, env, add)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, value, env, add)
        elif isinstance(target, (ast.Attribute, ast.Subscript)):
            # known fields and keys are variables of their own; others join their container
            key = self.place(target)
            if key:
                env[key] = value | env.get(key, set()) if add else value
            else:
                self.bind(target.value, value, env, True)

    # ---- expressions: the nodes whose value may be in theirs

    def place(self, e: ast.expr) -> str:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            return f"{base}.{e.attr}" if (base := self.place(e.value)) else ""
        if isinstance(e, ast.Subscript) and isinstance(e.slice, ast.Constant):
            return f"{base}[{e.slice.value!r}]" if (base := self.place(e.value)) else ""
        return ""

    def dotted(self, e: ast.expr) -> str:
        if isinstance(e, ast.Name):
            return self.names.get(e.id, e.id)
        if isinstance(e, ast.Attribute):
            base = self.dotted(e.value)
            if base in ("self", "cls") and self.receiver:
                return f"{self.module}.{self.receiver}.{e.attr}"
            return f"{base}.{e.attr}" if base else e.attr
        return ""

    def value(self, e: ast.expr | None, env: dict[str, set[str]]) -> set[str]:
        if e is None or isinstance(e, ast.Constant):
            return set()
        if isinstance(e, ast.Name):
            return env.get(e.id, set())
        if isinstance(e, (ast.Attribute, ast.Subscript)):
            key = self.place(e)
            if key in env:
                return env[key]
            return self.value(e.value, env)
        if isinstance(e, ast.Call):
            return {self.call(e, env)}
        if isinstance(e, ast.NamedExpr):
            found = self.value(e.value, env)
            self.bind(e.target, found, env)
            return found
        if isinstance(e, ast.IfExp):
            self.value(e.test, env)
            return self.value(e.body, env) | self.value(e.orelse, env)
        if isinstance(e, ast.Compare):
            for x in (e.left, *e.comparators):
                self.value(x, env)
            return set()
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            own = dict(env)
            for g in e.generators:
                self.bind(g.target, self.value(g.iter, own), own)
            return set().union(*(self.value(x, own) for x in ((e.key, e.value) if isinstance(e, ast.DictComp) else (e.elt,))))
        if isinstance(e, ast.Lambda):
            return self.value(e.body, dict(env))
        return set().union(*(self.value(x, env) for x in ast.iter_child_nodes(e) if isinstance(x, ast.expr)), set())

    def call(self, e: ast.Call, env: dict[str, set[str]]) -> str:
        path = self.dotted(e.func)
        receiver = self.value(e.func.value, env) if isinstance(e.func, ast.Attribute) else set()
        given = [(str(i), a) for i, a in enumerate(e.args)] + [(k.arg or "**", k.value) for k in e.keywords]
        args = []
        for index, a in given:
            found = self.value(a, env)
            literal = a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else ""
            args.append((index, found, literal))
        method = path.rsplit(".", 1)[-1]
        node_id = self.node("code.Call", e, method=method, callee_path=path, str_args=[x for *_, x in args])
        for index, found, literal in args:
            arg = self.node("code.Arg", e, callee_path=path, method=method, props={"fn": self.function, "call": node_id, "index": index, "literal": literal})
            self.flow(found, arg)
            self.flow({arg}, node_id)
        self.flow(receiver, node_id)
        return node_id


def lower(path: str, text: str | None) -> tuple[list[dict], list[tuple[str, str]]]:
    """Nodes and flows of a module; a text that does not parse gives one ``code.Unparsed`` node."""
    try:
        low = Lowering(path, text or "")
    except (SyntaxError, ValueError, RecursionError):
        return [{"node_id": f"{path}#0", "node_type": "code.Unparsed", "loc": f"{path}:0", "region": "", "ord": 0, "scope": "", "method": "", "callee_path": "", "str_args": [], "props": {}, "module": path}], []
    return low.nodes, low.edges


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files`` (path, content): lowered module by module, then linked by joins."""
    columns = [f.split(" ", 1)[0] for f in ROW_SCHEMA.replace("array<string>", "a").replace("map<string,string>", "m").split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                nodes, edges = lower(path, content)
                rows += [{"kind": "node"} | n for n in nodes] + [{"kind": "edge", "src": a, "dst": b} for a, b in edges]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype(object).where(out.notna(), None).assign(ord=out["ord"].astype("Int32"))

    rows = files.select("path", "content").mapInPandas(run, ROW_SCHEMA)
    nodes = rows.where("kind = 'node'").drop("kind", "src", "dst")
    edges = rows.where("kind = 'edge'").select(F.lit("FLOWS").alias("edge_type"), "src", "dst")
    return nodes, edges.unionByName(links(nodes)).distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Flows between functions: arguments to parameters by place or name, returns to the calls."""
    of = lambda t: nodes.where(F.col("node_type") == t)
    prop = lambda k: F.element_at("props", F.lit(k))
    params = of("code.Param").select(F.col("node_id").alias("dst"), F.col("callee_path").alias("fn"), prop("index").alias("at"), prop("name").alias("name"))
    args = of("code.Arg").select(F.col("node_id").alias("src"), F.col("callee_path").alias("fn"), prop("index").alias("at"))
    by_place = args.join(params, ["fn", "at"]).select("src", "dst")
    by_name = args.join(params.drop("at").withColumnRenamed("name", "at"), ["fn", "at"]).select("src", "dst")
    returns = of("code.Return").select(F.col("node_id").alias("src"), prop("fn").alias("fn"))
    calls = of("code.Call").select(F.col("node_id").alias("dst"), F.col("callee_path").alias("fn"))
    return by_place.union(by_name).union(returns.join(calls, "fn").select("src", "dst")).select(F.lit("FLOWS").alias("edge_type"), "src", "dst")
