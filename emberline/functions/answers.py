"""Answers of models against a schema that is data: what they say, every rule that they break, and what a second try is told.

A text's JSON is parsed once, as a variant, so a field of a wrong type is told apart from a missing one and from one that can be read all the same:
numbers and truth values that are written as text or as each other count. Keys that no field names are let pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import registry
from emberline.functions.text import extract_json, strip

#: How truth values may be written as text.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]
ERROR = "struct<field:string,rule:string,found:string>"


@dataclass(frozen=True)
class Field:
    """A field of an answer. kind: string, boolean, number, strings, or objects with fields of their own."""

    name: str
    kind: str
    required: bool = True
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    fields: tuple[Field, ...] = field(default=())


VERDICT = (
    Field("failure_class", "string", choices=tuple(registry.FAILURE_CLASSES)),
    Field("subcategory", "string"),
    Field("related_to_diff", "boolean"),
    Field("confidence", "number", low=0.0, high=1.0),
    Field("evidence", "strings", required=False),
    Field("reasoning", "string", required=False),
)
LOCALIZATION = (Field("ranked_files", "objects", required=False, fields=(Field("path", "string"), Field("confidence", "number", low=0.0, high=1.0), Field("why", "string", required=False))),)
FIX = (Field("patch", "string", required=False), Field("strategy", "string", required=False), Field("expected_effect", "string", required=False), Field("touched_files", "strings", required=False))
EDITS = (Field("edits", "objects", required=False, fields=(Field("path", "string"), Field("find", "string"), Field("replace", "string"))), Field("strategy", "string", required=False), Field("expected_effect", "string", required=False))

_TYPES = {"string": "string", "boolean": "boolean", "number": "double", "strings": "array<string>"}


def _type_of(f: Field) -> str:
    if f.kind == "objects":
        return "array<struct<" + ",".join(f"{g.name}:{_type_of(g)}" for g in f.fields) + ">>"
    return _TYPES[f.kind]


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _shape(v: Column) -> Column:
    """string, boolean, number, array, object or null of a variant; null without one."""
    told = F.schema_of_variant(v)
    return (
        F.when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(F.startswith(told, F.lit("ARRAY")), "array")
        .when(F.startswith(told, F.lit("OBJECT")), "object").when(told == "VOID", "null").when(told.isNotNull(), "number")
    )


def _read(v: Column, f: Field) -> Column:
    """The value of a field, null where it is missing or can't be read."""
    shape = _shape(_get(v, f.name, "variant"))
    text, number = _get(v, f.name, "string"), _get(v, f.name, "double")
    if f.kind == "string":
        return F.when(shape == "string", text)
    if f.kind == "boolean":
        word = F.lower(strip(text))
        written = F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
        return F.when(shape == "boolean", _get(v, f.name, "boolean")).when(shape == "string", written).when((shape == "number") & number.isin(0.0, 1.0), number == 1.0)
    if f.kind == "number":
        written = F.when(strip(text).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), strip(text).try_cast("double"))
        return F.when(shape == "number", number).when(shape == "string", written).when(shape == "boolean", F.when(_get(v, f.name, "boolean"), 1.0).otherwise(0.0))
    items = _get(v, f.name, "array<variant>")
    if f.kind == "strings":
        return F.when((shape == "array") & F.forall(items, lambda x: _shape(x).eqNullSafe(F.lit("string"))), F.transform(items, lambda x: x.try_cast("string")))
    one = lambda x: F.struct(*[_read(x, g).alias(g.name) for g in f.fields])
    return F.when((shape == "array") & F.forall(items, lambda x: _shape(x).eqNullSafe(F.lit("object"))), F.transform(items, one))


def _error(place: Column, rule: str, found: Column) -> Column:
    return F.struct(place.alias("field"), F.lit(rule).alias("rule"), F.left(found, F.lit(80)).alias("found"))


def _errors(v: Column, f: Field, place: Column) -> Column:
    """All that a field of an object breaks, as an array; place is what stands before its name."""
    name = F.concat(place, F.lit(f.name))
    raw = _get(v, f.name, "variant")
    value = _read(v, f)
    found = F.coalesce(_get(v, f.name, "string"), F.to_json(raw))
    word = {"string": "a text", "boolean": "true or false", "number": "a number", "strings": "a list of texts", "objects": "a list of objects"}[f.kind]
    checks = [F.when(raw.isNotNull() & value.isNull(), _error(name, f"must be {word}", found))]
    if f.required:
        checks.append(F.when(raw.isNull(), _error(name, "is missing", F.lit(None).cast("string"))))
    if f.choices:
        checks.append(F.when(~value.isin(list(f.choices)), _error(name, "must be one of " + ", ".join(f.choices), found)))
    if f.low is not None:
        checks.append(F.when(value < f.low, _error(name, f"must be at least {f.low:g}", found)))
    if f.high is not None:
        checks.append(F.when(value > f.high, _error(name, f"must be at most {f.high:g}", found)))
    own = F.array_compact(F.array(*checks)).cast(f"array<{ERROR}>")
    if f.kind != "objects":
        return own

    def inside(x: Column, i: Column) -> Column:
        at = F.concat(name, F.lit("."), i.cast("string"), F.lit("."))
        return F.concat(*[_errors(x, g, at) for g in f.fields])

    items = F.when(value.isNotNull(), _get(v, f.name, "array<variant>"))
    return F.concat(own, F.coalesce(F.flatten(F.transform(items, inside)), F.array().cast(f"array<{ERROR}>")))


def checked(answers: DataFrame, text: str, fields: tuple[Field, ...] = VERDICT, name: str = "checked") -> DataFrame:
    """answers with `name`: struct(valid, value, errors) of the JSON in a text.

    errors has a struct(field, rule, found) for each rule that is broken; fields of lists are told by their places, from 0. A text
    without a JSON object has one error, without a field; so has one that tells a key twice. value has null for fields that are
    missing or can't be read, and is null without an object. A null text is no JSON.
    """
    payload = extract_json(F.coalesce(F.col(text), F.lit("")))
    v = F.col("answer_variant")
    rows = answers.withColumn("answer_payload", payload).withColumn("answer_variant", F.try_parse_json("answer_payload"))
    is_object = F.coalesce(_shape(v) == "object", F.lit(False))
    none = F.array(_error(F.lit(""), "must be a JSON object", F.col("answer_payload"))).cast(f"array<{ERROR}>")
    errors = F.when(is_object, F.concat(*[_errors(v, f, F.lit("")) for f in fields])).otherwise(none)
    value = F.when(is_object, F.struct(*[_read(v, f).cast(_type_of(f)).alias(f.name) for f in fields]))
    rows = rows.withColumn("answer_errors", errors).withColumn("answer_value", value)
    told = F.struct((F.size("answer_errors") == 0).alias("valid"), F.col("answer_value").alias("value"), F.col("answer_errors").alias("errors"))
    return rows.withColumn(name, told).drop("answer_payload", "answer_variant", "answer_errors", "answer_value")


def error_text(errors: Column) -> Column:
    """Errors one a line."""

    def line(e: Column) -> Column:
        place = F.when(e["field"] == "", "the answer").otherwise(e["field"])
        return F.concat(place, F.lit(" "), e["rule"], F.when(e["found"].isNotNull(), F.concat(F.lit(", got "), e["found"])).otherwise(""))

    return F.array_join(F.transform(errors, line), "\n")


def feedback(raw: Column, errors: Column) -> Column:
    """What a model is told that gave this answer."""
    # The wording of the message.
    parts = ("Your previous answer did not match the required schema.\nAnswer was:\n", "\n\nErrors:\n", "\n\nReply with corrected JSON only. No prose, no code fences.")
    return F.concat(F.lit(parts[0]), F.coalesce(raw, F.lit("")), F.lit(parts[1]), error_text(errors), F.lit(parts[2]))


def error_rows(rows: DataFrame, key: list[str], name: str = "checked") -> DataFrame:
    """(key, field, rule, found): a row for each rule that an answer breaks."""
    return rows.select(*key, F.explode(F.col(name)["errors"]).alias("e")).select(*key, "e.*")


def settled(answers: DataFrame, fields: tuple[Field, ...] = VERDICT, tries: int = 2, what: str = "TriageVerdict") -> DataFrame:
    """(request_id, value, repaired, n_answers, input_tokens, output_tokens, error) of answers(request_id, attempt, text, input_tokens, output_tokens).

    Of a request's first `tries` answers, in the order of attempt, the first that is valid counts, and none after it was asked for; repaired says that it wasn't
    the very first. Tokens are those of all answers up to it. Without a valid one, value is null and error tells what is wrong with the last.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("request_id").orderBy("attempt")
    first = answers.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= tries)
    rows = checked(first, "text", fields)
    good_before = F.coalesce(F.max(F.col("checked.valid")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("asked", ~good_before).where("asked")
    last = lambda c: F.max_by(c, "turn")
    sums = rows.groupBy("request_id").agg(last("checked").alias("last"), F.max("turn").alias("n_answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    valid = F.col("last.valid")
    error = F.when(~valid, F.concat(F.lit(f"{what} did not validate after "), F.col("n_answers").cast("string"), F.lit(" attempts: "), error_text(F.col("last.errors"))))
    return sums.select("request_id", F.when(valid, F.col("last.value")).alias("value"), (valid & (F.col("n_answers") > 1)).alias("repaired"), "n_answers", "input_tokens", "output_tokens", error.alias("error"))


def taxonomy_error(failure_class: Column, subcategory: Column) -> Column:
    """Why a valid answer's subcategory isn't one of its class; null if it is."""
    known = F.create_map(*[x for c, subs in registry.SUBCATEGORIES.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in sorted(subs)]))])
    allowed = F.try_element_at(known, failure_class)
    text = F.concat(F.lit("'"), subcategory, F.lit("' is not a subcategory of "), failure_class, F.lit(". Expected one of: "), F.array_join(allowed, ", "))
    return F.when(~F.array_contains(allowed, subcategory), text)
