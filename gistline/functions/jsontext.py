"""JSON documents held in text columns, as token strings and as VARIANT values.

Whether a text is JSON is decided on its tokens: one letter each, so a string or a number of any length
costs one letter, and a key that occurs twice is no error. ``tokens`` works on any piece of a text that is cut at line
ends, because no JSON string spans lines; ``folded`` reduces a run of pieces to a short form that can be
put together with those around it, so a document need not be in one place.

Paths are ``$``, ``.key`` and ``[n]``. Output is compact JSON with sorted keys; of equal keys the last one counts
(``spark.sql.variant.allowDuplicateKeys``, which ``session.configure`` sets).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deepest nesting of a document.
MAX_DEPTH = 127
ESCAPE = (
    r"\\(?:[\"\\/bfnrt]|u(?:[0-9abcefABCEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}"
    r"|[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}))"
)
STRING = r'"[^"\\\x00-\x1f]*"'
SCALAR = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
#: What may be a number that no double holds.
HUGE = r"[0-9]{309}|[eE]\+?[0-9]{3}"
#: Tokens in a wrong order: two side by side, or a key where a level has elements, or the reverse.
WRONG = (
    r"!|s[svx{\[]|[vx][svx:{\[]|[}\]][svx:{\[]|\{[^s}]|[\[,:][,:}]|[,:]\]|:[svx]:|:[svx],[svx],|,[svx],s:"
)
#: A closed array or object.
CLOSED = r"\[(?:[svx](?:,[svx])*)?\]|\{(?:s:[svx](?:,s:[svx])*)?\}"
#: Brackets that hold no brackets and still are not closed rightly.
BROKEN = r"[\[{][^\[\]{}]*[\]}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column) -> Column:
    """Tokens of a piece of a document: brackets, commas and colons, ``s`` for a string and ``v`` for another scalar.
    ``!`` is a piece that no document holds."""
    plain = F.regexp_replace(F.regexp_replace(text, ESCAPE, "."), STRING, "\u0001")

    def of(rest: Column) -> Column:
        numbers = F.regexp_extract_all(rest, F.lit(f"({SCALAR})"), F.lit(1))
        small = F.when(~rest.rlike(HUGE), True).otherwise(F.forall(
            numbers, lambda n: F.coalesce(F.abs(n.try_cast("double")) < float("inf"), F.lit(True))))
        found = F.regexp_replace(F.regexp_replace(rest, SCALAR, "0"), r"[ \t\r\n]+", "")
        return _let(found, lambda t: F.when(small & ~t.rlike("[^0\u0001{}\\[\\],:]"), F.translate(t, "0\u0001", "vs")).otherwise("!"))

    # Elsewhere than in a string, where they are not allowed either, these would pass for the mark of a string.
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "!").otherwise(_let(plain, of))


def depths(form: Column) -> Column:
    """(net, top) of a token string: brackets opened less closed, and the deepest point from its start."""
    brackets = F.filter(F.split(F.translate(form, "sv,:!", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("net"), F.lit(0).alias("top"))

    def step(at: Column, c: Column) -> Column:
        net = at["net"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(net.alias("net"), F.greatest(at["top"], net).alias("top"))

    return F.aggregate(brackets, start, step)


def _count(form: Column, letters: str) -> Column:
    return F.length(form) - F.length(F.translate(form, letters, ""))


def folded(form: Column) -> Column:
    """The short form of a token string. What is closed becomes ``x``; of many elements or members of a level, one of
    the inner ones stays. ``folded(a + b) = folded(folded(a) + folded(b))``, and a document folds to ``x``."""
    def inner(s: Column) -> Column:
        s = F.regexp_replace(s, CLOSED, "x")
        return F.regexp_replace(F.regexp_replace(s, ",[svx](?:,[svx])+,", ",x,"), ",s:[svx](?:,s:[svx])+,", ",s:x,")

    def wrong(s: Column) -> Column:
        deep = (_count(s, "[{") > MAX_DEPTH) | (_count(s, "]}") > MAX_DEPTH)
        return F.when(s.rlike(WRONG) | s.rlike(BROKEN) | deep, "!").otherwise(s)

    # Every pass closes one level.
    passes = F.sequence(F.lit(0), F.least(_count(form, "[{"), F.lit(MAX_DEPTH)))
    reduced = F.aggregate(passes, form, lambda s, _: inner(s))
    return F.when(form.rlike(WRONG), "!").otherwise(_let(reduced, wrong))


def json_valid(text: Column) -> Column:
    """Strict: one document and nothing after it.

    The tokens are given to the JSON parser with empty strings and zeros for scalars. As an object
    member they must parse, and as an array element be the only one; trailing text fails one or the other.
    """
    def document(form: Column) -> Column:
        return _let(F.replace(F.replace(form, F.lit("s"), F.lit('""')), F.lit("v"), F.lit("0")), lambda plain: F.coalesce(
            F.json_array_length(F.concat(F.lit("["), plain, F.lit("]"))) == 1, F.lit(False)) & F.json_object_keys(
            F.concat(F.lit('{"":'), plain, F.lit("}"))).isNotNull())

    def shallow(form: Column) -> Column:
        return F.when(_count(form, "[{") <= MAX_DEPTH, True).otherwise(depths(form)["top"] <= MAX_DEPTH)

    begins = text.rlike(r'^[ \t\r\n]*[\[{"0-9tfn-]')
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(~begins, False).otherwise(
        _let(tokens(text), lambda form: F.when(form.contains("!"), False).otherwise(document(form) & shallow(form))))


# A segment of a path is text: ``.`` and a key, or ``#`` and an index. Paths may be columns, so one plan serves any
# number of path lists.


def path_segments(path: Column) -> Column:
    """Segments of a path; null when it is not one."""
    rest = F.when(path.startswith("$"), F.substring(path, 2, 2_147_483_647)).otherwise(path)
    parts = F.regexp_extract_all(rest, F.lit(r"(\.[^.\[]*|\[[^\]]*\]?|[^.\[].*)"), F.lit(1))

    def part(p: Column) -> Column:
        number = F.regexp_extract(p, r"^\[([0-9]+)\]*$", 1)
        return F.when(p.startswith("."), p).when(number != "", F.concat(F.lit("#"), _plain_number(number)))

    found = F.transform(parts, part)
    return F.when(F.forall(found, lambda p: p.isNotNull()), found)


def drop_segments(path: Column) -> Column:
    """Segments of the member that a removal names: what follows the last dot is a key, and digits before it are
    an index. Null for a path without a dot."""
    rest = F.when(path.startswith("$"), F.substring(path, 2, 2_147_483_647)).otherwise(path)
    parent, last = (F.regexp_extract(rest, r"(?s)^(.*)\.([^.]*)$", i) for i in (1, 2))
    walked = F.transform(F.filter(F.split(parent, r"[.\[\]]"), lambda p: p != ""), lambda p: F.when(
        p.rlike("^[0-9]+$"), F.concat(F.lit("#"), _plain_number(p))).otherwise(F.concat(F.lit("."), p)))
    return F.when(rest.contains("."), F.concat(walked, F.array(F.concat(F.lit("."), last))))


def _plain_number(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def _key(part: Column) -> Column:
    return F.substring(part, 2, 2_147_483_647)


def _variant_path(parts: Column) -> Column:
    """A path of Spark, which has no escapes: a key stands between quotes of the kind it does not hold."""
    def quoted(p: Column) -> Column:
        # An index past every array there can be finds nothing, as it should.
        index = F.coalesce(_key(p).try_cast("int"), F.lit(2_147_483_647)).cast("string")
        return F.when(p.startswith("#"), F.concat(F.lit("["), index, F.lit("]"))).when(
            p.contains('"'), F.concat(F.lit("['"), _key(p), F.lit("']"))).otherwise(F.concat(F.lit('["'), _key(p), F.lit('"]')))

    return F.concat(F.lit("$"), F.array_join(F.transform(parts, quoted), ""))


def _addressed(parts: Column) -> Column:
    """Segments with the path Spark reads; a key with quotes of both kinds has none, and its members are read as a map."""
    odd = F.exists(parts, lambda p: p.contains('"') & p.contains("'"))
    return F.struct(parts.alias("parts"), F.when(~odd, _variant_path(parts)).alias("path"))


def _at(document: Column, place: Column) -> Column:
    """Value at an addressed path as a variant; SQL NULL where it is missing, a null variant where it
    is an explicit null."""
    def inside(text: Column, p: Column) -> Column:
        element = F.get(F.from_json(text, "array<variant>"), _key(p).try_cast("int"))
        return F.to_json(F.when(p.startswith("#"), element).otherwise(F.element_at(F.from_json(text, "map<string,variant>"), _key(p))))

    direct = F.try_variant_get(document, F.coalesce(place["path"], F.lit("$")), "variant")
    walked = F.try_parse_json(F.aggregate(place["parts"], F.to_json(document), inside))
    return F.when(place["path"].isNotNull(), direct).when(place["parts"].isNotNull(), walked)


def json_get(document: Column, parts: Column) -> Column:
    """Value at the segments of a path."""
    return _at(document, _addressed(parts))


def _parsed(df: DataFrame, paths: list[str] | Column, segments: Callable[[Column], Column]) -> Column:
    """Paths with their places. A list is parsed once and becomes a literal, a column is parsed where it is."""
    def parsed(column: Column) -> Column:
        return F.transform(column, lambda p: F.struct(p.alias("k"), _addressed(segments(p)).alias("place")))

    if isinstance(paths, Column):
        return parsed(paths)
    once = df.sparkSession.createDataFrame([(list(paths),)], "p array<string>").select(F.to_json(parsed(F.col("p")))).first()[0]
    return F.from_json(F.lit(once), "array<struct<k string, place struct<parts array<string>, path string>>>")


def json_path_keep(df: DataFrame, column: str, paths: list[str] | Column) -> DataFrame:
    """Object that maps each path found, as written, to its value; other text is unchanged.
    The document is parsed once, in a step of its own. ``paths`` may be a column; where it is null, the text stays."""
    df = df.withColumns({"_paths": _parsed(df, paths, path_segments), "_valid": json_valid(F.col(column)), "_doc": F.try_parse_json(F.col(column))})

    def member(path: Column) -> Column:
        name = F.to_json(F.struct(path["k"].alias("k")))  # {"k":"..."}
        value = F.to_json(_at(F.col("_doc"), path["place"]))
        return F.concat(F.substring(name, F.lit(6), F.length(name) - 6), F.lit(":"), value)

    members = F.filter(F.transform(F.array_sort(F.array_distinct("_paths")), member), lambda m: m.isNotNull())
    kept = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    able = F.col("_valid") & F.col("_doc").isNotNull() & F.col("_paths").isNotNull()
    return df.withColumn(column, F.when(able, kept).otherwise(F.col(column))).drop("_paths", "_valid", "_doc")


def json_path_drop(df: DataFrame, column: str, paths: list[str] | Column) -> DataFrame:
    """Remove the object member each path names; array elements and absent members stay. The paths are folded over
    the document one after another. ``paths`` may be a column; where it is null, the text stays."""
    df = df.withColumns({"_paths": _parsed(df, paths, drop_segments), "_valid": json_valid(F.col(column)), "_json": sorted_json(F.col(column))})

    def one(text: Column, path: Column) -> Column:
        place = path["place"]
        return F.when(_at(F.try_parse_json(text), place).isNotNull(), _removed(text, place["parts"])).otherwise(text)

    able = F.col("_valid") & F.col("_json").isNotNull() & F.col("_paths").isNotNull()
    return df.withColumn(column, F.when(able, F.aggregate("_paths", F.col("_json"), one)).otherwise(F.col(column))).drop(
        "_paths", "_valid", "_json")


def _removed(text: Column, parts: Column) -> Column:
    """Down the path to the text of each container on it, the member out of the last one, and up again."""
    def members(t: Column) -> Column:
        return F.from_json(t, "map<string,variant>")

    def put(at: Column, part: Column, new: Column) -> Column:
        value = F.try_parse_json(new)
        inside = F.to_json(F.transform_values(members(at), lambda k, v: F.when(k == _key(part), value).otherwise(v)))
        element = F.to_json(F.transform(F.from_json(at, "array<variant>"), lambda v, i: F.when(
            i == _key(part).try_cast("int"), value).otherwise(v)))
        return F.when(part.startswith("#"), element).otherwise(inside)

    n = F.size(parts)
    levels = F.aggregate(F.slice(parts, F.lit(1), n - 1), F.array(text), lambda found, part: F.concat(found, F.array(
        F.to_json(json_get(F.try_parse_json(F.element_at(found, -1)), F.array(part))))))

    def upward(levels: Column) -> Column:
        last = F.to_json(F.map_filter(members(F.element_at(levels, -1)), lambda k, v: k != _key(F.element_at(parts, -1))))
        back = F.when(n > 1, F.sequence(n - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(back, last, lambda new, i: put(F.element_at(levels, i), F.element_at(parts, i), new))

    return _let(levels, upward)


def sorted_json(text: Column) -> Column:
    """Compact form; a variant keeps object keys in code-point order."""
    return F.to_json(F.try_parse_json(text))


def json_path_exists(text: Column, path: str) -> Column:
    """Dotted keys only: ``a[0]`` is looked up as that very key, and ``$`` is true for any JSON."""
    rest = path[1:] if path.startswith("$") else path
    keys = [k for k in rest.split(".") if k]
    valid = json_valid(text)
    if not keys:
        return valid
    return valid & json_get(F.try_parse_json(text), F.array(*[F.lit("." + k) for k in keys])).isNotNull()


def string_field(text: Column, field: str) -> Column:
    """A top-level member when it is a string, else NULL."""
    value = json_get(F.try_parse_json(text), F.array(F.lit("." + field)))
    return F.when(json_valid(text) & (F.schema_of_variant(value) == "STRING"), F.try_variant_get(value, "$", "string"))


def ndjson_keeps(text: Column, field: str | Column, keep_values: list[str] | Column) -> Column:
    """Whether a line is JSON with a string member whose value is in the list."""
    if isinstance(field, str):
        return F.coalesce(string_field(text, field).isin(*keep_values), F.lit(False))
    # A member name held in a column: read the members as a map.
    members = F.from_json(text, "map<string,variant>")
    value = F.get(F.map_values(F.map_filter(members, lambda k, v: k == field)), F.lit(0))
    found = (F.schema_of_variant(value) == "STRING") & F.array_contains(
        keep_values, F.try_variant_get(value, "$", "string"))
    return F.coalesce(json_valid(text) & found, F.lit(False))
