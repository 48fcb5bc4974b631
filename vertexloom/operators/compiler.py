"""From the checked form of a query to one DataFrame.

A row holds a column ``v{vid}__{name}`` for everything later steps need of a visited
vertex and, where an optional edge lies above it, ``v{vid}__exists``.  Edges are
joins or explodes; a fold is an aggregate over the distinct values it depends on,
joined back.  Nothing runs while a plan is built.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators import ranges
from vertexloom.operators.predicates import literal, predicate
from vertexloom.plans import ir
from vertexloom.plans.hints import VertexHints, vertex_hints
from vertexloom.plans.planner import bind, counts_used, fold_join, predicates
from vertexloom.sources.spec import TYPENAME, EdgeArray, EdgeKeys, EdgeTable, Source, asked, quoted, takes


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class Compiler:
    def __init__(self, source: Source, query: ir.Query, arguments: dict[str, object]):
        self.source, self.schema, self.query = source, source.schema, query
        self.arguments = bind(query, arguments)
        self.used_counts = counts_used(query.component)
        self.types: dict[int, str] = {}
        self.needed: dict[int, set[str]] = defaultdict(set)
        self.absent: set[int] = set()
        self.fold_parent: dict[int, int] = {}
        self.selective = False  # some filter with a constant has been applied
        self.counted: list[ir.Predicate] = []  # filters that a fold's count sees to
        self._survey(query.component)
        while self._copy_needs(query.component):
            pass

    # what is needed where

    def _survey(self, c: ir.Component) -> None:
        for v in c.vertices.values():
            self.types[v.vid] = v.type_name
            if v.coerced_from:
                self.needed[v.vid].add(TYPENAME)
        for ref in c.outputs.values():
            self.needed[ref.vid].add(ref.name)
        for s in c.steps:
            edge = self.source.find_edge(self.types[s.from_vid], s.name)
            self.needed[s.from_vid].update(edge.uses)
            if isinstance(s, ir.Fold):
                self.fold_parent[s.eid] = s.from_vid
                self._survey(s.component)
            elif s.recursion:
                declared = s.recursion.coerce_to or self._target(s)
                self.needed[s.to_vid].update(self.source.find_edge(declared, s.name).uses)
                if s.recursion.coerce_to:
                    self.needed[s.to_vid].add(TYPENAME)
        for p in predicates(c):
            for ref in (p.left, p.right.ref if isinstance(p.right, ir.TagRef) else None):
                if isinstance(ref, ir.PropertyRef):
                    self.needed[ref.vid].add(ref.name)

    def _copy_needs(self, c: ir.Component) -> bool:
        """A recursion's first level is its start, which must then hold what the other levels hold."""
        grown = False
        for s in c.steps:
            if isinstance(s, ir.Fold):
                grown |= self._copy_needs(s.component)
            elif s.recursion and not self.needed[s.to_vid] <= self.needed[s.from_vid]:
                self.needed[s.from_vid] |= self.needed[s.to_vid]
                grown = True
        return grown

    def _target(self, s: ir.Edge | ir.Fold) -> str:
        return self.schema.field(self.types[s.from_vid], s.name).type.name

    def hints(self, v: ir.Vertex, c: ir.Component, binding: bool = True) -> VertexHints:
        one = lambda f: fold_join(f, self.arguments, self.used_counts, f.from_vid in self.absent) in ("semi", "inner")
        return vertex_hints(v, c, self.needed, self.arguments, binding, one)

    # columns

    @staticmethod
    def name(vid: int, what: str) -> str:
        return f"v{vid}__{what}"

    def exists(self, vid: int) -> Column:
        return F.col(self.name(vid, "exists"))

    def ref_name(self, ref: ir.Ref) -> str:
        return f"f{ref.eid}__count" if isinstance(ref, ir.CountRef) else self.name(ref.vid, ref.name)

    def owner(self, ref: ir.Ref) -> int:
        """The vertex whose absence makes the value meaningless."""
        return self.fold_parent[ref.eid] if isinstance(ref, ir.CountRef) else ref.vid

    def keep_if(self, p: ir.Predicate) -> Column:
        right, constant, has = None, None, False
        if isinstance(p.right, ir.VariableRef):
            constant, has = self.arguments[p.right.name], True
            right = literal(constant, self.query.variables[p.right.name])
        elif p.right is not None:
            right = F.col(self.ref_name(p.right.ref))
        right_type = p.right.ref.type if isinstance(p.right, ir.TagRef) else None
        never_null = (has and constant is not None) or not p.left.type.is_nullable or (right_type is not None and not right_type.is_nullable)
        out = predicate(p.op, F.col(self.ref_name(p.left)), right, constant, has, filtering=True, never_null=never_null)
        owners = {self.owner(p.left)} | ({self.owner(p.right.ref)} if isinstance(p.right, ir.TagRef) else set())
        for vid in sorted(owners & self.absent):
            out = ~self.exists(vid) | out
        return out

    # vertices and edges

    def enter(self, df: DataFrame, v: ir.Vertex) -> DataFrame:
        if v.coerced_from:
            fits = F.col(self.name(v.vid, TYPENAME)).isin(self.schema.concrete(v.type_name))
            df = df.where(~self.exists(v.vid) | F.coalesce(fits, F.lit(False)) if v.vid in self.absent else fits)
        for p in v.filters:
            if any(p is q for q in self.counted):
                continue
            self.selective |= isinstance(p.right, ir.VariableRef)
            df = df.where(self.keep_if(p))
        return df

    def _order(self, edge, target: str) -> tuple[str, ...]:
        return self.source.order_of(target) if getattr(edge, "order", None) is None else edge.order

    def starts(self, df: DataFrame, edge: EdgeTable, own: str, hints: VertexHints | None) -> dict[str, DataFrame]:
        """What a fetching edge starts from: distinct keys and the tags that its vertices are compared with."""
        if not isinstance(edge, EdgeTable) or not takes(edge.rows, "starts"):
            return {}
        tags = [F.col(self.ref_name(t.ref)).alias(t.name) for t in (hints.tags if hints else ()) if self.ref_name(t.ref) in df.columns]
        return {"starts": df.select(*[F.col(own + a).alias(a) for a in edge.uses], *tags).distinct()}

    def far(self, edge: EdgeKeys, target: str, parameters: dict, names: set[str], prefix: str, ordered: bool, hints: VertexHints | None = None, starts: dict | None = None, more: tuple[str, ...] = ()) -> DataFrame:
        """The far side of a keyed edge, its columns prefixed, and the expressions ``more``; keys are ``{prefix}key{i}``."""
        extra = {b for _, b in edge.on} | (set(self._order(edge, target)) if ordered else set())
        raw = None
        if isinstance(edge, EdgeTable):
            raw = edge.rows(self.source.spark, **parameters, **asked(edge.rows, hints), **(starts or {}))
        elif edge.where is not None:
            raw = self.source.table_of(target)[0].raw
            raw = raw.where(edge.where(lambda n: raw[n], **parameters))
        df = self.source.frame(target, names | extra, "", raw, hints)
        columns = [f"{quoted(n)} AS {quoted(prefix + n)}" for n in sorted(names)] + [f"{quoted(b)} AS {prefix}key{i}" for i, (_, b) in enumerate(edge.on)]
        if ordered:
            columns.append(f"struct({', '.join(map(quoted, self._order(edge, target))) or '0'}) AS {prefix}ord")
        return df.selectExpr(*columns, *more)

    def by_order(self, df: DataFrame, s: ir.Edge | ir.Fold, v: ir.Vertex) -> ir.Predicate | None:
        """A filter that compares many neighbours by order with a tag from elsewhere than the start, which may differ among starts of one key."""
        many = self.schema.field(self.types[s.from_vid], s.name).type.is_list
        for p in v.filters if many else ():
            if p.op in ranges.OPS and isinstance(p.right, ir.TagRef) and (o := self.owner(p.right.ref)) not in (s.from_vid, v.vid) and o not in self.absent and self.ref_name(p.right.ref) in df.columns:
                return p
        return None

    def hop(self, df: DataFrame, edge, target: str, parameters: dict, start: int | str, to: str, names: set[str], how: str, ordered: bool, hints: VertexHints | None = None, only: str | None = None, vertex: ir.Vertex | None = None, by: ir.Predicate | None = None) -> DataFrame:
        """Append the columns ``{to}{name}`` of the neighbours; with ``how`` left also ``{to}exists``.  Rows for which the column ``only`` is false have none.

        With ``by``, a filter of the ``vertex`` that the caller goes on to apply, pairs that it drops may be left out.
        """
        own = self.name(start, "") if isinstance(start, int) else start
        if isinstance(edge, EdgeArray):
            array = edge.array(lambda n: F.col(own + n), **parameters)
            array = F.when(self.exists(start), array) if isinstance(start, int) and start in self.absent else array
            array = F.when(F.col(only), array) if only else array
            explode = F.posexplode_outer if how == "left" else F.posexplode
            df = df.select("*", explode(array).alias(to + "pos", to + "at"))
            table, holder = self.source.table_of(target)
            get = lambda n: F.col(to + "at")[n]
            made = {n: self.source.column(holder if table.typename else target, n, get) for n in sorted(names)}
            if how == "left":  # what is worked out from nothing is nothing
                made = {n: F.when(F.col(to + "pos").isNotNull(), c) for n, c in made.items()}
            columns = [c.alias(to + n) for n, c in made.items()]
            columns += [F.struct(F.col(to + "pos")).alias(to + "ord")] if ordered else []
            columns += [F.col(to + "pos").isNotNull().alias(to + "exists")] if how == "left" else []
            return df.select(*[c for c in df.columns if c not in (to + "pos", to + "at")], *columns)
        right = self.far(edge, target, parameters, names, to, ordered, hints, self.starts(df, edge, own, hints), (f"TRUE AS {to}here",) if how == "left" else ())
        if by and how == "inner" and not (df.isStreaming or right.isStreaming):
            for p in vertex.filters:
                right = right if isinstance(p.right, ir.TagRef) else right.where(self.keep_if(p))
            met = ranges.pairs(df, right, [(own + a, f"{to}key{i}") for i, (a, _) in enumerate(edge.on)], self.ref_name(by.right.ref), by.op, self.ref_name(by.left))
            return met.drop(*[f"{to}key{i}" for i in range(len(edge.on))])
        on = [f"{quoted(own + a)} = {to}key{i}" for i, (a, _) in enumerate(edge.on)]
        out = [*map(quoted, df.columns), *[quoted(to + n) for n in sorted(names)], *([to + "ord"] if ordered else []), *([f"coalesce({to}here, FALSE) AS {to}exists"] if how == "left" else [])]
        return df.join(right, F.expr(" AND ".join([*on, only] if only else on)), how).selectExpr(*out)

    def follow(self, df: DataFrame, s: ir.Edge, c: ir.Component, ordered: bool) -> DataFrame:
        v, source, to = c.vertices[s.to_vid], self.types[s.from_vid], self.name(s.to_vid, "")
        edge, target, names = self.source.find_edge(source, s.name), v.coerced_from or v.type_name, self.needed[s.to_vid]
        if s.recursion:
            return self.recurse(df, s, edge, target, ordered)
        below = s.from_vid in self.absent
        if v.coerced_from and not s.optional and not below:
            target = v.type_name  # other types would be dropped at once: don't read them
        df = self.hop(df, edge, target, s.parameters, s.from_vid, to, names, "left" if s.optional or below else "inner", ordered, self.hints(v, c, not s.optional and not below), vertex=v, by=self.by_order(df, s, v))
        if s.optional or below:
            self.absent.add(s.to_vid)
            if not s.optional:
                df = df.where(~self.exists(s.from_vid) | self.exists(s.to_vid))
        return df

    def recurse(self, df: DataFrame, s: ir.Edge, edge, target: str, ordered: bool) -> DataFrame:
        """A row for each vertex on the way, from the start on: one join a hop.

        At each hop a row that still leads on is doubled: one copy stays as it is, the
        other goes on to the neighbours and is dropped if there are none.  Rows that stay keep
        their keys, so they spread over tasks like the others.
        """
        names, to, base, step = sorted(self.needed[s.to_vid]), self.name(s.to_vid, ""), [*map(quoted, df.columns)], "n__"
        below, live, go = s.from_vid in self.absent, step + "live", step + "go"
        deeper = self.source.find_edge(s.recursion.coerce_to or target, s.name)
        here = self.name(s.from_vid, "exists") if below else "TRUE"
        tail, path = [to + "exists"] if below else [], [to + "ord"] if ordered else []
        df = df.selectExpr(*base, *[f"{quoted(self.name(s.from_vid, n))} AS {quoted(to + n)}" for n in names], *[f"{here} AS {t}" for t in tail], f"{here} AS {live}")
        leads = ", ".join(f"'{t}'" for t in self.schema.concrete(s.recursion.coerce_to)) if s.recursion.coerce_to else ""
        for k in range(s.recursion.depth):
            on = f"{live} AND {quoted(to + TYPENAME)} IN ({leads})" if k and leads else live
            df = df.selectExpr("*", f"explode(CASE WHEN {on} THEN array(FALSE, TRUE) ELSE array(FALSE) END) AS {go}")
            df = self.hop(df, deeper if k else edge, target, s.parameters, to, step, set(names), "left", ordered, only=go)
            came, ways = step + "exists", []
            if ordered:
                one = f"array({step}ord)"
                before = to + "ord" if k else f"slice({one}, 1, 0)"
                ways = [f"CASE WHEN {came} THEN {f'concat({to}ord, {one})' if k else one} ELSE {before} END AS {to}ord"]
            df = df.where(f"NOT {go} OR {came}").selectExpr(*base, *[f"CASE WHEN {came} THEN {quoted(step + n)} ELSE {quoted(to + n)} END AS {quoted(to + n)}" for n in names], *tail, f"{came} AS {live}", *ways)
        if below:
            self.absent.add(s.to_vid)
        return df.selectExpr(*base, *[quoted(to + n) for n in names], *tail, *path)

    # folds

    def counts_by(self, df: DataFrame, s: ir.Fold, edge, target: str) -> ir.Predicate | None:
        """The one filter inside a fold that needs a value from outside, if it compares by order, so that elements can be counted without pairs."""
        if not isinstance(edge, EdgeKeys) or (isinstance(edge, EdgeTable) and takes(edge.rows, "starts")) or df.isStreaming:
            return None
        outside = [p for p in predicates(s.component) if isinstance(p.right, ir.TagRef) and p.right.ref in s.imported]
        own = [p for v in s.component.vertices.values() for p in v.filters]
        if len(outside) != 1 or outside[0].op not in ranges.OPS or not any(p is outside[0] for p in own):
            return None
        p = outside[0]
        if self.ref_name(p.right.ref) in {self.name(s.from_vid, a) for a in edge.uses} or self.may_be_absent(s.component, p.left.vid):
            return None
        far = self.source.frame(target, {b for _, b in edge.on})
        whole = {"tinyint", "smallint", "int", "bigint"}
        kinds = [{df.schema[self.name(s.from_vid, a)].dataType.simpleString(), far.schema[b].dataType.simpleString()} for a, b in edge.on]
        return p if not far.isStreaming and all(len(k) == 1 or k <= whole for k in kinds) else None

    @staticmethod
    def may_be_absent(c: ir.Component, vid: int) -> bool:
        """Whether an optional edge lies above a vertex of the component."""
        above = {s.to_vid: s for s in c.steps if isinstance(s, ir.Edge)}
        while vid in above:
            if above[vid].optional:
                return True
            vid = above[vid].from_vid
        return False

    def fold(self, df: DataFrame, s: ir.Fold) -> DataFrame:
        edge, target = self.source.find_edge(self.types[s.from_vid], s.name), self._target(s)
        v = s.component.vertices[s.to_vid]
        if v.coerced_from:
            target = v.type_name
        own, to = self.name(s.from_vid, ""), self.name(s.to_vid, "")
        below = s.from_vid in self.absent
        names, ordered = self.needed[s.to_vid], bool(s.component.all_outputs())
        carried = sorted({self.ref_name(r) for r in s.imported} | {self.name(o, "exists") for r in s.imported if (o := self.owner(r)) in self.absent})
        carried = [c for c in carried if c not in {own + a for a in edge.uses}]
        keys = [own + a for a in edge.uses] + carried
        by = self.counts_by(df, s, edge, target) if carried and not ordered else None
        if isinstance(edge, EdgeKeys) and (by or not carried):
            own_hints = self.hints(v, s.component)
            inner = self.far(edge, target, s.parameters, names, to, ordered, own_hints, self.starts(df, edge, own, own_hints))
            inner = inner.where(_all(F.col(f"{to}key{i}").isNotNull() for i in range(len(edge.on))))
            inner = inner.withColumnsRenamed({f"{to}key{i}": own + a for i, (a, _) in enumerate(edge.on)})
            if self.selective and ordered:  # lists don't shrink before the shuffle: collect only those asked for
                few = (df.where(self.exists(s.from_vid)) if below else df).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).distinct()
                inner = inner.join(few, _all(F.col(k) == F.col(f"k{i}") for i, k in enumerate(keys)), "left_semi")
        else:
            start = df.where(self.exists(s.from_vid)) if below else df
            absent, self.absent = self.absent, self.absent - {s.from_vid}
            start = start.select(*keys).distinct()
            inner = self.hop(start, edge, target, s.parameters, s.from_vid, to, names, "inner", ordered, self.hints(v, s.component), vertex=v, by=self.by_order(start, s, v))
            self.absent = absent
        self.counted += [by] if by else []
        inner = self.component(self.enter(inner, v), s.component, ordered)
        how = fold_join(s, self.arguments, self.used_counts, below)
        same = lambda: _all(F.col(k).eqNullSafe(F.col(f"k{i}")) if k in carried or isinstance(edge, EdgeArray) else F.col(k) == F.col(f"k{i}") for i, k in enumerate(keys))
        outputs, count = s.component.all_outputs(), f"f{s.eid}__count"
        if by:
            starts = (df.where(self.exists(s.from_vid)) if below else df).select(*keys).distinct()
            owner = self.owner(by.right.ref)
            inner = ranges.counts(starts, inner, [own + a for a in edge.uses], self.ref_name(by.right.ref), by.op, self.ref_name(by.left), count, self.name(owner, "exists") if owner in self.absent else None)
        if how in ("semi", "anti"):
            return df.join(inner.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), same(), f"left_{how}")
        aggregates = [F.count(F.lit(1)).alias(count)]
        if outputs:
            order = [self.name(e.to_vid, "ord") for e in [s, *s.component.steps] if isinstance(e, ir.Fold) is (e is s)]
            row = F.struct(*[F.col(o) for o in order], *[F.col(f"o__{n}") for n in outputs])
            aggregates.append(F.array_sort(F.collect_list(row)).alias("list"))
        inner = inner.select(*inner.columns, *[F.col(self.ref_name(r)).alias(f"o__{n}") for n, r in s.component.outputs.items()])
        named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
        grouped = inner.select(*named, count) if by else inner.groupBy(*named).agg(*aggregates)
        grouped = grouped.select(*[f"k{i}" for i in range(len(keys))], count, *[F.col("list")[f"o__{n}"].alias(f"o__{n}") for n in outputs])
        kinds = {n: grouped.schema[f"o__{n}"].dataType for n in outputs}
        out = df.join(grouped, same(), how).drop(*[f"k{i}" for i in range(len(keys))])
        full = {count: F.coalesce(count, F.lit(0).cast("long"))} | {f"o__{n}": F.coalesce(f"o__{n}", F.array().cast(kinds[n])) for n in outputs}
        if how == "left":
            out = out.withColumns({n: F.when(self.exists(s.from_vid), c) if below else c for n, c in full.items()})
        for p in s.filters:
            out = out.where(self.keep_if(p))
        return out.withColumns({f"o__{n}": F.col(count) for n in s.outputs}) if s.outputs else out

    def component(self, df: DataFrame, c: ir.Component, ordered: bool) -> DataFrame:
        for s in c.steps:
            if isinstance(s, ir.Fold):
                df = self.fold(df, s)
            else:
                v = c.vertices[s.to_vid]
                df = self.enter(self.follow(df, s, c, ordered), v)
        return df

    def dataframe(self) -> DataFrame:
        q, c = self.query, self.query.component
        v = c.vertices[c.root]
        root_type = v.coerced_from or v.type_name
        df = self.source.start(q.root_name, root_type, q.root_parameters, self.needed[c.root], self.name(c.root, ""), self.hints(v, c))
        df = self.component(self.enter(df, v), c, False)
        of = {n: self.ref_name(r) for n, r in c.outputs.items()}
        return df.selectExpr(*[f"{quoted(of.get(n, f'o__{n}'))} AS {quoted(n)}" for n in sorted(c.all_outputs())])
