"""What is refused, and with which code."""

from __future__ import annotations

import pytest

from vertexloom.errors import ArgumentError, ErrorGroup, FrontendError, LoomError, ParseError, SchemaError, ValidationError
from vertexloom.plans import frontend
from vertexloom.plans.planner import bind
from vertexloom.schema import Schema
from vertexloom.sources.numbers import SDL
from vertexloom.syntax import shorthand


def compile_query(schema: Schema, text: str):
    return frontend.compile_query(schema, shorthand(text))


def codes(e: LoomError) -> list[str]:
    return e.codes if isinstance(e, ErrorGroup) else [e.code]


@pytest.fixture(scope="module")
def numbers():
    return Schema(SDL)


PARSE = {
    "{ One { value @shout } }": "UnrecognizedDirective",
    '{ One { value @filter(op: "=", val: ["$x"]) } }': "UnrecognizedDirectiveArgument",
    '{ One { value @filter(op: "=", op: "=", value: ["$x"]) } }': "DuplicatedDirectiveArgument",
    "{ One { value @filter(op: 3) } }": "InappropriateTypeForDirectiveArgument",
    '{ One { value @filter(op: "=") } }': "MissingRequiredDirectiveArgument",
    '{ One { value @filter(op: "=", value: "$x") } }': "FilterExpectsListNotString",
    '{ One { value ?(like $x) } }': "UnsupportedFilterOperator",
    '{ One { value ?(= x) } }': "InvalidFilterOperandName",
    '{ One { value ?(= $) } }': "InvalidFilterOperandName",
    '{ One { value ?(= %) } }': "InvalidFilterOperandName",
    '{ One { value ?(= $2x) } }': "InvalidFilterOperandName",
    '{ One { value ?(= $å) } }': "InvalidFilterOperandName",
    '{ One { value @filter(op: "=", value: []) } }': "OtherError",
    '{ One { value @output(name: "a b-c") } }': "InvalidOutputName",
    '{ One { value @tag(name: "a$") } }': "InvalidTagName",
    '{ One { multiple(max: 2) @fold @transform(op: "sum") } }': "UnsupportedTransformOperator",
    '{ One { multiple(max: 2) &count @fold } }': "UnsupportedDirectivePosition",
    "{ One { multiple(max: 2) @fold @output } }": "UnsupportedDirectivePosition",
    "{ One { multiple(max: 2) @fold @tag } }": "UnsupportedDirectivePosition",
    "{ One { multiple(max: 2) @fold @optional { value @output } } }": "UnsupportedDirectivePosition",
    "{ One { successor @fold @recurse(depth: 2) { value @output } } }": "UnsupportedDirectivePosition",
    '{ One { successor @fold &count @optional { value } } }': "UnsupportedDirectivePosition",
    "{ One { successor @fold @fold { value @output } } }": "UnsupportedDuplicatedDirective",
    "{ One { successor @optional @optional { value @output } } }": "UnsupportedDuplicatedDirective",
    "{ One { successor @recurse(depth: 1) @recurse(depth: 2) { value @output } } }": "UnsupportedDuplicatedDirective",
    "{ One { successor @recurse(depth: 0) { value @output } } }": "InappropriateTypeForDirectiveArgument",
    "{ Number(max: {a: 1}) { value @output } }": "InvalidFieldArgument",
    "{ Number(max: $x) { value @output } }": "InvalidFieldArgument",
    "{ Number(max: 1, max: 2) { value @output } }": "DuplicatedEdgeParameter",
    "{ One { value @output } Two { value @output } }": "MultipleQueryRoots",
    "{ ... on Number { value @output } }": "UnsupportedQueryRoot",
    "query @output { One { value @output } }": "DirectiveNotInsideQueryRoot",
    "{ One @output { value } }": "DirectiveNotInsideQueryRoot",
    "query($x: Int) { One { value @output } }": "VariableDefinitionInQuery",
    "mutation { One { value @output } }": "DocumentNotAQuery",
    "{ One { value @output } } { Two { value @output } }": "MultipleOperationsInDocument",
    "fragment F on Number { value } { One { ...F } }": "DocumentContainsNonInlineFragments",
    "{ One { ...F } }": "UnsupportedSyntax",
    "{ Number(max: 3) { ... on Prime { ... on Prime { value @output } } } }": "NestedTypeCoercion",
    "{ Number(max: 3) { ... on Prime { value @output } name @output } }": "TypeCoercionWithSiblingFields",
    "{ Number(max: 3) { ... on Prime @optional { value @output } } }": "UnsupportedDirectivePosition",
    "{ One { value @output }": "InvalidGraphQL",
    "{ One { ? } }": "InvalidGraphQL",
    "": "OtherError",
}


@pytest.mark.parametrize("query", PARSE)
def test_parse_errors(numbers, query):
    with pytest.raises(ParseError) as e:
        compile_query(numbers, query)
    assert e.value.code == PARSE[query]


FRONTEND = {
    "{ Five { value @output } }": ["NonExistentPath"],
    "{ One { size @output } }": ["NonExistentPath"],
    "{ Two { ... on Composite { value @output } } }": ["CannotCoerceNonInterfaceType"],
    "{ One { ... on Nothing { value @output } } }": ["NonExistentType"],
    "{ One { ... on Letter { its: name @output } } }": ["CannotCoerceToUnrelatedType"],
    "{ One { __typename { value @output } } }": ["PropertyMetaFieldUsedAsEdge"],
    '{ One { __typename ?(is_not_null) @output } }': ["NonNullableTypeFilteredForNullability"],
    "{ One { value @output @output } }": ["MultipleOutputsWithSameName"],
    "{ One { value @output successor { value @output } } }": ["MultipleOutputsWithSameName"],
    "{ One { a: value @output(name: \"x\") successor { x: value @output } } }": ["MultipleOutputsWithSameName"],
    '{ One { value @output successor @fold &count @output(name: "value") } }': ["MultipleOutputsWithSameName"],
    "{ One { value @tag @output } }": ["UnusedTags"],
    '{ One { value @tag name @tag(name: "value") @output successor { value ?(= %value) } } }': ["MultipleTagsWithSameName"],
    '{ One { value @output ?(= %no) } }': ["UndefinedTagInFilter"],
    '{ One { value @output ?(= %t) successor { value @tag(name: "t") } } }': ["TagUsedBeforeDefinition"],
    '{ One { successor @fold { value @tag(name: "t") @output } predecessor { value ?(= %t) } } }': ["TagUsedOutsideItsFoldedSubquery"],
    '{ One { successor @fold { value ?(= %t) @output } value @tag(name: "t") } }': ["UndefinedTagInFilter"],
    '{ One { successor @fold &count @tag(name: "n") { value @output ?(= %n) } } }': ["UndefinedTagInFilter"],
    '{ One { value @output successor @fold &count @tag } }': ["ExplicitTagNameRequired"],
    '{ One { value @output ?(contains $x) } }': ["ListFilterOperationOnNonListSubject"],
    '{ One { value @output vowelsInName ?(contains %v) v: value @tag(name: "v") } }': ["TypeMismatchBetweenFilterSubjectAndArgument"],
    '{ One { value @output ?(one_of %n) name @tag(name: "n") } }': ["ListFilterOperationOnNonListArgument"],
    '{ One { value @output ?(one_of %n) vowelsInName @tag(name: "n") } }': ["TypeMismatchBetweenFilterSubjectAndArgument"],
    '{ One { value @output ?(regex $x) } }': ["StringFilterOperationOnNonStringSubject"],
    '{ One { name @output ?(regex %v) value @tag(name: "v") } }': ["StringFilterOperationOnNonStringArgument"],
    '{ One { name @output ?(= %v) value @tag(name: "v") } }': ["TypeMismatchBetweenFilterSubjectAndArgument"],
    '{ One { value @output ?(= $x) name ?(= $x) } }': ["IncompatibleVariableTypeRequirements"],
    '{ One { value @output ?(one_of $x) ?(= $x) } }': ["IncompatibleVariableTypeRequirements"],
    "{ One { value @output @fold } }": ["UnsupportedDirectiveOnProperty"],
    "{ One { value @output @optional } }": ["UnsupportedDirectiveOnProperty"],
    "{ One { value @output @recurse(depth: 2) } }": ["UnsupportedDirectiveOnProperty"],
    "{ One { value @output successor @output } }": ["UnsupportedEdgeOutput"],
    '{ One { value @output successor ?(= $x) } }': ["UnsupportedEdgeFilter"],
    "{ One { value @output successor @tag } }": ["UnsupportedEdgeTag"],
    "{ One { successor @optional @fold { value @output } } }": ["UnsupportedDirectiveOnFoldedEdge"],
    "{ One { successor @recurse(depth: 2) @fold { value @output } } }": ["UnsupportedDirectiveOnFoldedEdge"],
    "{ Number { value @output } }": ["MissingRequiredEdgeParameter"],
    "{ Number(max: 2, least: 1) { value @output } }": ["UnexpectedEdgeParameter"],
    '{ Number(max: "2") { value @output } }': ["InvalidEdgeParameterType"],
    "{ Number(max: 2, min: null) { value @output } }": ["InvalidEdgeParameterType"],
    "{ Four { primeFactor @recurse(depth: 2) { value @output } } }": ["RecursingNonRecursableEdge"],
    "{ Number(max: 3) { multiple(max: 3) @recurse(depth: 2) { value @output } } }": ["RecursionToSubtype"],
    "{ One { value } }": ["OtherError"],
    '{ One { successor @fold &count &count @output { value } } }': ["OtherError"],
}


@pytest.mark.parametrize("query", FRONTEND)
def test_frontend_errors(numbers, query):
    with pytest.raises((FrontendError, ValidationError, ErrorGroup)) as e:
        compile_query(numbers, query)
    assert set(FRONTEND[query]) <= set(codes(e.value))


RECURSION = """
schema { query: Q }
type Q { Top: Final  Mid: Deeper  Twice: Twice }
type Final implements Deeper & Derived & Base { away: Other  side: Derived  down: Derived  field: Int }
interface Deeper implements Derived & Base { side: Base  down: Derived  field: Int }
interface Derived implements Base { down: Base  field: Int }
interface Base { field: Int }
type Other { field: Int  away: Final }
type Twice implements Base { field: Int  only: Base }
"""


@pytest.mark.parametrize(
    "query,code",
    [
        ("{ Mid { down @recurse(depth: 2) { field @output } } }", "EdgeRecursionNeedingMultipleCoercions"),
        ("{ Mid { side @recurse(depth: 2) { field @output } } }", None),
        ("{ Top { side @recurse(depth: 2) { field @output } } }", "EdgeRecursionNeedingMultipleCoercions"),
        ("{ Top { away @recurse(depth: 2) { field @output } } }", "RecursingNonRecursableEdge"),
        ("{ Twice { only @recurse(depth: 2) { field @output } } }", None),
    ],
)
def test_recursion_types(query, code):
    schema = Schema(RECURSION)
    if code:
        with pytest.raises(FrontendError) as e:
            compile_query(schema, query)
        assert e.value.code == code
    else:
        step = compile_query(schema, query).component.steps[0]
        assert step.recursion.coerce_to == ("Deeper" if "side" in query else "Twice")


def in_schema(body: str, roots: str = "Start: Thing") -> str:
    return f"schema {{ query: Q }} type Q {{ {roots} }} {body}"


SCHEMAS = {
    in_schema("type Thing { a: Int } type Thing { b: Int }"): "DuplicateTypeOrInterfaceDefinition",
    in_schema("type Thing { a: Int a: Int }"): "DuplicateFieldDefinition",
    in_schema("type Thing implements No { a: Int }"): "ImplementingNonExistentType",
    in_schema("type Thing implements Other { a: Int } type Other { a: Int }"): "ImplementingNonInterface",
    in_schema("interface A { a: Int } interface B implements A { a: Int } type Thing implements B { a: Int }"): "MissingTransitiveInterfaceImplementation",
    in_schema("interface A { a: Int } type Thing implements A { b: Int }"): "MissingRequiredField",
    in_schema("interface A { a: Int! } type Thing implements A { a: Int }"): "InvalidTypeWideningOfInheritedField",
    in_schema("interface A { a: Int } type Thing implements A { a: String }"): "InvalidTypeWideningOfInheritedField",
    in_schema("interface A { e(x: Int): Thing } type Thing implements A { e: Thing }"): "InheritedFieldMissingParameters",
    in_schema("interface A { e: Thing } type Thing implements A { e(x: Int): Thing }"): "InheritedFieldUnexpectedParameters",
    in_schema("interface A { e(x: Int): Thing } type Thing implements A { e(x: Int!): Thing }"): "InvalidTypeNarrowingOfInheritedFieldParameter",
    in_schema("type Thing { a: Int } type __Odd { a: Int }"): "ReservedTypeName",
    in_schema("type Thing { __a: Int }"): "ReservedFieldName",
    in_schema("type Thing { a(x: Int): Int }"): "PropertyFieldWithParameters",
    in_schema("type Thing { a: Int }", "Start: Thing count: Int"): "PropertyFieldOnRootQueryType",
    in_schema("type Thing { up: Q }"): "EdgePointsToRootQueryType",
    in_schema("type Thing { a: [[Thing]] }"): "InvalidEdgeType",
    in_schema("type Thing { a: Color }"): "UnknownPropertyOrEdgeType",
    in_schema('type Thing { e(x: Int! = "a"): Thing }'): "InvalidDefaultValueForFieldParameter",
    in_schema("type Thing { e(x: Int! = null): Thing }"): "InvalidDefaultValueForFieldParameter",
    in_schema("interface A implements B { a: Int } interface B implements A { a: Int } type Thing { a: Int }"): "CircularImplementsRelationships",
    in_schema("interface A { a: Int } interface B { a: Int } type Thing implements A & B { a: Int }"): "AmbiguousFieldOrigin",
    in_schema("type Thing { a: Int } enum Color { RED }"): "UnsupportedDefinition",
    in_schema("type Thing { a: Int } union U = Thing"): "UnsupportedDefinition",
    "type Q { a: Q }": "MissingQueryType",
    in_schema("type Thing { a Int }"): "InvalidGraphQL",
}


@pytest.mark.parametrize("text", SCHEMAS)
def test_schema_errors(text):
    with pytest.raises((SchemaError, ErrorGroup)) as e:
        Schema(text)
    assert SCHEMAS[text] in codes(e.value)


def test_arguments(numbers):
    q = compile_query(numbers, '{ Number(max: 5) { value @output ?(< $a) name ?(one_of $b) ?(regex $c) } }')
    assert {n: str(t) for n, t in q.variables.items()} == {"a": "Int!", "b": "[String]!", "c": "String!"}
    good = {"a": 3, "b": ["x", None], "c": "a|b"}
    assert bind(q, good) == good
    for change, code in (
        ({"a": None}, "ArgumentTypeError"),
        ({"a": 2.0}, "ArgumentTypeError"),
        ({"a": True}, "ArgumentTypeError"),
        ({"b": None}, "ArgumentTypeError"),
        ({"b": [1]}, "ArgumentTypeError"),
        ({"d": 1}, "UnusedArguments"),
        ({"c": "("}, "InvalidPattern"),
        ({"c": "a(?=b)"}, "InvalidPattern"),
        ({"c": r"(a)\1"}, "InvalidPattern"),
    ):
        with pytest.raises(ArgumentError) as e:
            bind(q, good | change)
        assert e.value.code == code
    with pytest.raises(ErrorGroup) as e:
        bind(q, {"d": 1, "a": "x"})
    assert e.value.codes == ["MissingArguments", "UnusedArguments", "ArgumentTypeError"]
    narrowed = compile_query(numbers, '{ One { value @output ?(= $a) ?(> $a) } }')
    with pytest.raises(ArgumentError):
        bind(narrowed, {"a": None})
