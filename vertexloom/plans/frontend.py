"""Check a query against a schema and lower it to the checked form."""

from __future__ import annotations

from collections import defaultdict

from vertexloom.errors import ErrorGroup, FilterTypeError, FrontendError, LoomError, ValidationError, raise_all
from vertexloom.plans import ir
from vertexloom.plans.directives import EQUALITY, LISTED, MEMBER, ORDER, TEXT, UNARY, Filter, Node, Transform, query_tree
from vertexloom.schema import Schema
from vertexloom.syntax import FieldDef, parse_query
from vertexloom.types import Type

TYPENAME = "__typename"
_TYPENAME_TYPE = Type("String", (False,))


def validate(schema: Schema, parent: str, node: Node, path: tuple[str, ...] = ()) -> None:
    """Names and coercions."""
    if node.name == TYPENAME:
        if node.children:
            raise FrontendError("PropertyMetaFieldUsedAsEdge", TYPENAME)
        return
    f = schema.field(parent, node.name)
    path = (*path, node.name)
    if f is None:
        raise ValidationError("NonExistentPath", list(path))
    target = f.type.name
    if node.coerced_to:
        if target not in schema.types or schema.types[target].kind != "interface":
            raise ValidationError("CannotCoerceNonInterfaceType", target, node.coerced_to)
        if node.coerced_to not in schema.vertex_types:
            raise ValidationError("NonExistentType", node.coerced_to)
        if target not in schema.types[node.coerced_to].implements:
            raise ValidationError("CannotCoerceToUnrelatedType", target, node.coerced_to)
        target, path = node.coerced_to, (*path, node.coerced_to)
    for child in node.children:
        validate(schema, target, child, path)


class _Lowering:
    def __init__(self, schema: Schema):
        self.schema, self.errors = schema, []
        self.vids = self.eids = 0
        self.prefixes: list[str] = []
        self.paths: tuple[int, ...] = ()
        self.tags: dict[str, tuple[ir.Ref, tuple[int, ...]]] = {}
        self.used: set[str] = set()
        self.imports: dict[int, list[ir.Ref]] = {}
        self.variables: dict[str, Type] = {}
        self.names: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.optional: set[int] = set()  # vertices that may not exist
        self.output_types: dict[str, Type] = {}
        self.fold_optional: list[bool] = []

    def fail(self, error: LoomError) -> None:
        self.errors.append(error)

    # names

    def output_name(self, named, local: str) -> str:
        return named.name if named.name is not None else "".join(self.prefixes) + local

    def put_out(self, name: str, vertex: str, what: str, kind: Type, vid: int) -> bool:
        self.names[name].append((vertex, what))
        if vid in self.optional:
            kind = kind.with_nullable(True)
        for nullable in reversed(self.fold_optional):
            kind = kind.listed(nullable)
        self.output_types[name] = kind
        return len(self.names[name]) == 1

    def tag(self, name: str, ref: ir.Ref) -> None:
        if name in self.tags:
            self.fail(FrontendError("MultipleTagsWithSameName", name))
        else:
            self.tags[name] = (ref, self.paths)

    # filters

    def variable(self, name: str, kind: Type) -> ir.VariableRef:
        held = self.variables.get(name)
        both = kind if held is None else held.intersect(kind)
        if both is None:
            self.fail(FrontendError("IncompatibleVariableTypeRequirements", name, held, kind))
            both = held
        self.variables[name] = both
        return ir.VariableRef(name, both)

    def tag_operand(self, name: str, left: ir.Ref, use: int) -> ir.TagRef | None:
        if name not in self.tags:
            self.fail(FrontendError("UndefinedTagInFilter", left.name, name))
            return None
        ref, path = self.tags[name]
        if self.paths[: len(path)] != path:
            self.fail(FrontendError("TagUsedOutsideItsFoldedSubquery", left.name, name))
            return None
        if ref.defined_at > use:
            self.fail(FrontendError("TagUsedBeforeDefinition", left.name, name))
            return None
        for root in self.paths[len(path) :]:
            if ref not in self.imports[root]:
                self.imports[root].append(ref)
        self.used.add(name)
        return ir.TagRef(name, ref)

    def predicate(self, f: Filter, left: ir.Ref, use: int) -> ir.Predicate | None:
        kind = left.type
        if f.op in UNARY:
            if not kind.is_nullable:
                self.fail(FilterTypeError("NonNullableTypeFilteredForNullability", f.op, left.name, kind))
            return ir.Predicate(f.op, left, None)
        name, tagged = f.operand[1:], f.operand[0] == "%"
        if not self._left_fits(f.op, left):
            return None
        if not tagged:
            if f.op in EQUALITY:
                wanted = kind
            elif f.op in ORDER:
                wanted = kind.with_nullable(False)
            elif f.op in LISTED:
                wanted = kind.element()
            elif f.op in MEMBER:
                wanted = kind.listed(False)
            else:
                wanted = Type("String", (False,))
            return ir.Predicate(f.op, left, self.variable(name, wanted))
        right = self.tag_operand(name, left, use)
        if right is None or not self._right_fits(f.op, left, right):
            return None
        return ir.Predicate(f.op, left, right)

    def _left_fits(self, op: str, left: ir.Ref) -> bool:
        kind = left.type
        if op in ORDER and not kind.is_orderable:
            self.fail(FilterTypeError("OrderingFilterOperationOnNonOrderableSubject", op, left.name, kind))
        elif op in LISTED and not kind.is_list:
            self.fail(FilterTypeError("ListFilterOperationOnNonListSubject", op, left.name, kind))
        elif op in TEXT and (kind.is_list or kind.name != "String"):
            self.fail(FilterTypeError("StringFilterOperationOnNonStringSubject", op, left.name, kind))
        else:
            return True
        return False

    def _right_fits(self, op: str, left: ir.Ref, right: ir.TagRef) -> bool:
        a, b = left.type, right.ref.type
        code = None
        if op in ORDER and not b.is_orderable:
            code = "OrderingFilterOperationWithNonOrderableArgument"
        elif op in (*EQUALITY, *ORDER) and not a.same_but_nulls(b) or op in LISTED and not a.element().same_but_nulls(b):
            code = "TypeMismatchBetweenFilterSubjectAndArgument"
        elif op in MEMBER and not b.is_list:
            code = "ListFilterOperationOnNonListArgument"
        elif op in MEMBER and not b.element().same_but_nulls(a):
            code = "TypeMismatchBetweenFilterSubjectAndArgument"
        elif op in TEXT and (b.is_list or b.name != "String"):
            code = "StringFilterOperationOnNonStringArgument"
        if code:
            self.fail(FilterTypeError(code, op, f"{left.name}: {a}", f"%{right.name}: {b}"))
        return code is None

    # edges

    def parameters(self, f: FieldDef, given: dict[str, object]) -> dict[str, object]:
        out = {}
        for p in f.parameters:
            if p.name in given:
                value = given[p.name]
            elif p.has_default:
                value = p.default
            elif p.type.is_nullable:
                value = None
            else:
                self.fail(FrontendError("MissingRequiredEdgeParameter", p.name, f.name))
                continue
            if not p.type.accepts(value):
                self.fail(FrontendError("InvalidEdgeParameterType", p.name, f.name, p.type, value))
            out[p.name] = value
        for name in given:
            if name not in {p.name for p in f.parameters}:
                self.fail(FrontendError("UnexpectedEdgeParameter", name, f.name))
        return out

    def recursion(self, source: str, f: FieldDef, depth: int) -> ir.Recursion | None:
        s, target, name = self.schema, f.type.name, f.name
        if not s.is_subtype(target, source):
            code = "RecursionToSubtype" if s.is_subtype(source, target) else "RecursingNonRecursableEdge"
            self.fail(FrontendError(code, name, source, target))
            return None
        if source == target:
            return ir.Recursion(depth, None)
        if deeper := s.field(target, name):
            if deeper.type.name != target:
                self.fail(FrontendError("EdgeRecursionNeedingMultipleCoercions", name))
                return None
            return ir.Recursion(depth, None)
        origins = s.origins[source, name]
        if len(origins) > 1:
            self.fail(FrontendError("AmbiguousOriginEdgeRecursion", name))
            return None
        (origin,) = origins
        if s.fields[origin, name].type.name != target:
            self.fail(FrontendError("EdgeRecursionNeedingMultipleCoercions", name))
            return None
        return ir.Recursion(depth, origin)

    # vertices

    def component(self, node: Node, vid: int, declared: str) -> ir.Component:
        self.paths = (*self.paths, vid)
        self.imports[vid] = []
        out = ir.Component(vid)
        checks: dict[int, list[tuple[PropertyKey, list[Filter]]]] = {}
        self.vertex(out, node, vid, declared, checks)
        for v in sorted(checks):  # tags of the whole component are known now
            for (name, kind), filters in checks[v]:
                for f in filters:
                    if p := self.predicate(f, ir.PropertyRef(v, name, kind), v):
                        out.vertices[v].filters.append(p)
        self.paths = self.paths[:-1]
        return out

    def vertex(self, out: ir.Component, node: Node, vid: int, declared: str, checks) -> None:
        type_name = node.coerced_to or declared
        out.vertices[vid] = ir.Vertex(vid, type_name, declared if node.coerced_to and node.coerced_to != declared else None)
        if node.filters:
            self.fail(FrontendError("UnsupportedEdgeFilter", node.name))
        if node.outputs and not node.fold:
            self.fail(FrontendError("UnsupportedEdgeOutput", node.name))
        if node.tags:
            self.fail(FrontendError("UnsupportedEdgeTag", node.name))
        mine: dict[PropertyKey, list[Filter]] = {}
        for child in node.children:
            f = None if child.name == TYPENAME else self.schema.field(type_name, child.name)
            if f is not None and self.schema.is_edge(f):
                self.edge(out, child, vid, type_name, f, checks)
                continue
            for on, what in ((child.fold, "@fold"), (child.optional, "@optional"), (child.recurse, "@recurse")):
                if on:
                    self.fail(FrontendError("UnsupportedDirectiveOnProperty", what, child.name))
            if child.transform and not child.fold:
                self.fail(FrontendError("UnsupportedDirectiveOnProperty", "@transform", child.name))
            if child.arguments:
                self.fail(FrontendError("UnexpectedEdgeParameter", sorted(child.arguments), child.name))
            ref = ir.PropertyRef(vid, child.name, f.type if f else _TYPENAME_TYPE)
            local = child.alias or child.name
            for o in child.outputs:
                name = self.output_name(o, local)
                self.put_out(name, type_name, child.name, ref.type, vid)
                out.outputs[name] = ref
            for t in child.tags:
                self.tag(t.name or local, ref)
            mine.setdefault((child.name, ref.type), []).extend(child.filters)
        checks[vid] = list(mine.items())

    def edge(self, out: ir.Component, node: Node, vid: int, type_name: str, f: FieldDef, checks) -> None:
        self.vids += 1
        self.eids += 1
        to, eid = self.vids, self.eids
        parameters = self.parameters(f, node.arguments)
        self.prefixes.append(node.alias or "")
        if vid in self.optional or (node.optional and not node.fold and not node.recurse):
            self.optional.add(to)
        if node.fold:
            self.fold(out, node, vid, to, eid, f, parameters)
        else:
            if node.transform:
                self.fail(FrontendError("UnsupportedDirectiveOnProperty", "@transform", node.name))
            recursion = self.recursion(type_name, f, node.recurse) if node.recurse else None
            out.steps.append(ir.Edge(eid, vid, to, f.name, parameters, node.optional, recursion))
            self.vertex(out, node, to, f.type.name, checks)
        self.prefixes.pop()

    def fold(self, out: ir.Component, node: Node, vid: int, to: int, eid: int, f: FieldDef, parameters) -> None:
        for on, what in ((node.optional, "@optional"), (node.recurse, "@recurse")):
            if on:
                self.fail(FrontendError("UnsupportedDirectiveOnFoldedEdge", node.name, what))
        absent = vid in self.optional
        self.optional.discard(to)
        self.fold_optional.append(absent)
        inner = self.component(node, to, f.type.name)
        self.fold_optional.pop()
        fold = ir.Fold(eid, vid, to, f.name, parameters, inner, self.imports.pop(to))
        if node.outputs:
            self.fail(FrontendError("UnsupportedEdgeOutput", node.name))
        ref = ir.CountRef(eid, to)
        t: Transform | None = node.fold_transform
        if t:
            if t.again:
                self.fail(FrontendError("OtherError", "a count can't be transformed again"))
            fold.filters = [p for x in t.filters if (p := self.predicate(x, ref, to))]
            for o in t.outputs:
                name = self.output_name(o, ("" if node.alias else node.name) + "count")
                self.put_out(name, node.name, "count", ref.type.with_nullable(absent), vid)
                fold.outputs.append(name)
            for tag in t.tags:
                if tag.name is None:
                    self.fail(FrontendError("ExplicitTagNameRequired", node.name))
                else:
                    self.tag(tag.name, ref)
        out.steps.append(fold)


PropertyKey = tuple[str, Type]


def compile_query(schema: Schema, text: str) -> ir.Query:
    """The checked form of a query text; raises one error, or a group."""
    root = query_tree(parse_query(text))
    validate(schema, schema.query_type, root)
    low = _Lowering(schema)
    low.vids = 1
    f = schema.field(schema.query_type, root.name)
    parameters = low.parameters(f, root.arguments)
    component = low.component(root, 1, f.type.name)
    if not low.errors and (unused := sorted(set(low.tags) - low.used)):
        low.fail(FrontendError("UnusedTags", unused))
    if double := {n: w for n, w in low.names.items() if len(w) > 1}:
        low.fail(FrontendError("MultipleOutputsWithSameName", double))
    if not low.errors and not component.all_outputs():
        low.fail(FrontendError("OtherError", "the query puts out nothing"))
    raise_all(low.errors)
    # a variable's type may have narrowed after its first use
    return ir.Query(root.name, parameters, component, low.variables, dict(sorted(low.output_types.items())))


__all__ = ["TYPENAME", "ErrorGroup", "compile_query", "validate"]
