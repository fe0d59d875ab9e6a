"""Line protocol parsing as column expressions; no Python code runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.formats import unescape
from metricloom.functions.keys import family_id, once, span_family_id
from metricloom.schemas import PARSED_COLUMNS, TAGS

# Fixed patterns of the line format. Possessive quantifiers keep the Java matcher from recursing
# on long tokens.
TOKEN = r'((?:[^\s"]++|"(?:[^"\\]++|\\.)*+")++)'
NAME = r'^(?:[∆Δ]?[A-Za-z0-9][A-Za-z0-9._-]*|"(?:[^"\\]|\\.)++")$'
TAG = r'^[A-Za-z0-9._/-]++=(?:[^="][^"]*+|"(?:[^"\\]|\\.)++")$'
NUMBER = r"^[+-]?(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?$"
INTEGER = r"^\d++$"
EPOCH_SECONDS = r"^\d{10}$"
# Lines without quotes and backslashes, all fields well formed, and their fields as parts behind one
# another: metric lines of name, number, time or none, tags; spans of name, tags, start, duration.
_PLAIN_TAGS = r'[A-Za-z0-9._/-]++=[^ \t\n\x0b\f\r="\\][^ \t\n\x0b\f\r"\\]*+(?:\s++[A-Za-z0-9._/-]++=[^ \t\n\x0b\f\r="\\][^ \t\n\x0b\f\r"\\]*+)*+'
_PLAIN_NUMBER = r"[+-]?(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?"
MARK = "\x01"
PLAIN = rf"^([∆Δ]?)([A-Za-z0-9][A-Za-z0-9._-]*+)\s++({_PLAIN_NUMBER})(?:\s++(\d{{10}}))?\s++({_PLAIN_TAGS})\z"
PLAIN_PARTS = MARK.join(["$1", "$2", "$3", "$4", "$5"])
PLAIN_SPAN = rf"^([∆Δ]?[A-Za-z0-9][A-Za-z0-9._-]*+)\s++({_PLAIN_TAGS})\s++(\d++)\s++({_PLAIN_NUMBER})\z"
PLAIN_SPAN_PARTS = MARK.join(["span", "$1", "$4", "$3", "$2"])


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))


def skip_blank_and_comments(df: DataFrame, column: str = "value") -> DataFrame:
    text = F.trim(F.col(column))
    return df.filter((text != "") & ~text.startswith("#"))


def _token(i: int) -> Column:
    return F.try_element_at(F.col("_tok"), F.lit(i))


def _entries(parts: Column) -> Column:
    """``k=v`` tokens to key/value structs."""
    return F.transform(
        parts,
        lambda t: F.struct(
            F.substring_index(t, "=", 1).alias("key"),
            unescape(F.substring(t, F.instr(t, "=") + 1, F.length(t))).alias("value"),
        ),
    )


def last_wins_map(entries: Column) -> Column:
    """Map of key/value structs; a repeated key keeps its last value.

    The quadratic branch runs only on the rare lines that repeat a key, so the session's policy
    for duplicate map keys does not matter.
    """

    def build(found: Column) -> Column:
        keys = F.transform(found, lambda e: e["key"])
        last = F.filter(
            found,
            lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == e["key"]),
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(found), F.map_from_entries(found)).otherwise(
            F.map_from_entries(last)
        )

    return once(entries, build)


def _source(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("source")), F.try_element_at(tags, F.lit("host")))


def _own_tags(tags: Column) -> Column:
    """Drop the entry that served as source: ``source``, or ``host`` where there is no source."""
    has_source = F.map_contains_key(tags, "source")
    return F.map_filter(
        tags, lambda k, _: F.when(has_source, k != "source").otherwise(k != "host")
    )


def _bind(df: DataFrame, keep: list[str], **exprs: Column) -> DataFrame:
    """Compute ``exprs`` once per row and expose them as columns.

    The projection below evaluates them in generated code; the one-element ``inline`` above it
    keeps filters that callers put on parsed columns from being rewritten through the chain of
    projections, which would expand them into copies of the whole parser.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select(*keep, packed.alias("_once")).select(*keep, F.inline(F.array("_once")))


FAST = "_plain"


def _plain_points(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the fields of plain metric and span lines as one struct, null for all other lines.

    One pattern decides that a line has no quotes and is well formed throughout, and puts marks
    between its parts; the rest is search for fixed texts in generated code, without the token
    arrays the other lines go through. A repeated key, a missing source or a number without a
    finite double leave the line to the long way.
    """
    c = F.col
    line = c("_line")
    # only chooses the pattern to try: the second of the tokens between blanks holds an equals sign
    like_span = F.substring_index(F.substring_index(line, " ", 2), " ", -1).contains("=")
    marked = F.when(like_span, F.regexp_replace(line, PLAIN_SPAN, PLAIN_SPAN_PARTS)).otherwise(F.regexp_replace(line, PLAIN, PLAIN_PARTS))
    cut = _bind(df, [*keep, "_line"], _cut=F.when(~line.contains(MARK), F.split(marked, MARK, 5)))
    part = [F.try_element_at("_cut", F.lit(i)) for i in range(1, 6)]
    odd = F.lit(False)
    for blank in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        odd = odd | part[4].contains(blank)
    fields = _bind(
        cut, [*keep, "_line"], _kind=part[0], _name=part[1], _number=part[2].try_cast("double"), _at=part[3].try_cast("bigint"),
        _rest=F.concat(F.lit(" "), F.when(odd, F.regexp_replace(part[4], r"\s++", " ")).otherwise(part[4]), F.lit(" ")),
    )
    by_source = c("_rest").contains(" source=")
    after = F.when(by_source, F.substring_index("_rest", " source=", -1)).otherwise(F.substring_index("_rest", " host=", -1))
    keys = F.split(F.regexp_replace(F.trim("_rest"), "=[^ ]*+", ""), " ")
    named = _bind(
        fields, [*keep, "_line", "_kind", "_name", "_number", "_at", "_rest"], _keys=keys,
        _prefix=F.when(by_source, " source=").otherwise(" host="), _owner=F.substring_index(after, " ", 1),
    )
    is_span = c("_kind") == "span"
    good = (
        (by_source | c("_rest").contains(" host=")) & (F.size(F.array_distinct("_keys")) == F.size("_keys"))
        & c("_number").isNotNull() & (F.abs("_number") < F.when(is_span, 1e15).otherwise(float("inf")))
    )
    own = F.trim(F.replace("_rest", F.concat("_prefix", "_owner", F.lit(" ")), F.lit(" ")))
    taken = _bind(named, [*keep, "_line", "_kind", "_name", "_number", "_at", "_owner"], _own=F.when(good, own))
    is_span, is_point = c("_kind") == "span", c("_kind") != "span"
    point = F.struct(
        F.when(is_span, "span").otherwise("metric").alias("record_type"),
        F.when(is_point, c("_name")).alias("metric"), F.when(is_point, c("_number")).alias("value"), F.when(is_point, c("_at")).alias("ts"),
        c("_owner").alias("source"),
        F.when(c("_own") == "", F.create_map().cast(TAGS)).otherwise(F.str_to_map("_own", F.lit(" "), F.lit("="))).alias("tags"),
        F.when(is_point, c("_kind") != "").alias("is_delta"), F.when(is_span, c("_name")).alias("operation"),
        F.when(is_span, c("_at")).alias("start_ms"), F.when(is_span, F.floor("_number").try_cast("bigint")).alias("duration_ms"),
    )
    return _bind(taken, [*keep, "_line"], **{FAST: F.when(c("_own").isNotNull(), point)})


def parse_lines(df: DataFrame, column: str = "value", plain: bool = True) -> DataFrame:
    """Parse every non-blank, non-comment line into one typed row; nothing is dropped silently.

    A histogram header and its owner line may be joined into one value with a newline (see
    ``pair_two_line_histograms``). Other columns of ``df`` pass through. Plain metric and span lines,
    most of any capture, take a short way with the same results; ``plain=False`` sends them the long way too.
    """
    others = [c for c in df.columns if c != column and c not in PARSED_COLUMNS]
    text = F.trim(F.col(column))
    lines = skip_blank_and_comments(df, column)
    if plain:
        first = _plain_points(lines.select(*others, text.alias("_line")), others)
        keep = [*others, FAST]
        # a plain line has no tokens, so all that follows is null for it and costs little
        split = _bind(first, keep, _line=F.col("_line"), _tok=F.when(F.col(FAST).isNull(), tokens(F.col("_line"))))
    else:
        keep = others
        split = _bind(lines, keep, _line=text, _tok=tokens(text))

    # 1. kind of record and the slices of the token array each kind needs
    size = F.size("_tok")
    is_hist = _token(1).rlike("^![MHD]$")
    is_span = ~is_hist & F.coalesce(_token(2).rlike(r"^[^=\"]+=") , F.lit(False))
    hist_ts = is_hist & F.coalesce(_token(2).rlike(INTEGER), F.lit(False))
    point_ts = ~is_hist & ~is_span & F.coalesce(_token(3).rlike(EPOCH_SECONDS), F.lit(False))
    balanced = ~F.col("_line").contains('"') | (
        F.regexp_replace(F.array_join("_tok", ""), r"\s+", "") == F.regexp_replace("_line", r"\s+", "")
    )
    staged = _bind(
        split,
        [*keep, "_line", "_tok"],
        _balanced=balanced,
        _kind=F.when(is_hist, "histogram").when(is_span, "span").otherwise("metric"),
        _from=F.when(is_hist, F.when(hist_ts, 3).otherwise(2))
        .when(is_span, 2)
        .otherwise(F.when(point_ts, 4).otherwise(3)),
        _stamp=F.when(hist_ts, _token(2)).when(point_ts, _token(3)),
    )

    # 2. histogram body: leading run of numbers and #counts; the owner follows it
    rest = F.when(
        F.col("_kind") == "histogram", F.slice("_tok", F.col("_from"), F.size("_tok"))
    )
    owner_at = F.array_position(
        F.transform(rest, lambda t: ~(t.startswith("#") | t.rlike(NUMBER))), F.lit(True)
    )
    body_size = F.when(F.col("_owner") == 0, F.size("_rest")).otherwise(F.col("_owner") - 1).cast("int")
    tag_tokens = (
        F.when(
            F.col("_kind") == "histogram",
            F.when(F.col("_owner") > 0, F.slice("_rest", F.col("_owner").cast("int") + 1, F.size("_rest"))),
        )
        .when(F.col("_kind") == "span", F.slice("_tok", F.lit(2), F.greatest(F.size("_tok") - 3, F.lit(0))))
        .otherwise(F.slice("_tok", F.col("_from"), F.size("_tok")))
    )
    owned = _bind(staged, [*keep, "_line", "_tok", "_balanced", "_kind", "_from", "_stamp"], _rest=rest, _owner=owner_at)
    bodied = _bind(
        owned,
        [*keep, "_line", "_tok", "_balanced", "_kind", "_stamp", "_owner"],
        _body=F.slice("_rest", F.lit(1), body_size),
        _tags=F.coalesce(tag_tokens, F.array().cast("array<string>")),
        _raw_name=F.when(
            F.col("_kind") == "histogram",
            F.try_element_at("_rest", F.when(F.col("_owner") > 0, F.col("_owner").cast("int"))),
        ).otherwise(_token(1)),
    )

    # 3. typed pieces
    tags_ok = F.forall("_tags", lambda t: t.rlike(TAG))
    counted = F.size("_body") % 2 == 1
    half = F.floor(F.size("_body") / 2).cast("int")
    steps = F.filter(F.sequence(F.lit(0), half), lambda i: i < half)
    centroids = F.transform(
        steps,
        lambda i: F.struct(
            F.when(counted, F.try_element_at("_body", (i * 2 + 2).cast("int")))
            .otherwise(F.substr(F.try_element_at("_body", (i * 2 + 1).cast("int")), F.lit(2)))
            .try_cast("bigint")
            .alias("count"),
            F.when(counted, F.try_element_at("_body", (i * 2 + 3).cast("int")))
            .otherwise(F.try_element_at("_body", (i * 2 + 2).cast("int")))
            .try_cast("double")
            .alias("value"),
        ),
    )
    is_hist_row = F.col("_kind") == "histogram"
    is_span_row = F.col("_kind") == "span"
    typed = _bind(
        bodied,
        [*keep, "_kind", "_line", "_balanced", "_stamp", "_raw_name"],
        _size=F.size("_tok"),
        _tags_ok=tags_ok,
        _all_tags=F.when(tags_ok, last_wins_map(_entries(F.col("_tags")))),
        _has_source=F.exists("_tags", lambda t: t.startswith("source=") | t.startswith("host=")),
        _value=F.when(_token(2).rlike(NUMBER), _token(2).try_cast("double")),
        _centroids=F.when(is_hist_row, centroids),
        _declared=F.when(
            is_hist_row & counted, F.substr(F.try_element_at("_body", F.lit(1)), F.lit(2)).try_cast("bigint")
        ),
        _granularity=F.when(is_hist_row, F.substring(_token(1), 2, 1)),
        _last=F.when(is_span_row, F.element_at("_tok", F.lit(-1))),
        _second_last=F.when(is_span_row, F.try_element_at("_tok", F.lit(-2))),
        _has_owner=F.col("_owner") > 0,
        _shape_ok=F.when(
            is_hist_row,
            F.try_element_at("_body", F.lit(1)).startswith("#")
            & (half > 0)
            & F.when(
                counted,
                F.forall(F.slice("_body", F.lit(2), F.size("_body")), lambda t: ~t.startswith("#")),
            ).otherwise(
                F.forall(
                    steps,
                    lambda i: F.try_element_at("_body", (i * 2 + 1).cast("int")).startswith("#")
                    & ~F.try_element_at("_body", (i * 2 + 2).cast("int")).startswith("#"),
                )
            ),
        ),
    )

    # 4. verdict
    bad_name = ~F.col("_balanced") | ~F.col("_raw_name").rlike(NAME)
    finite = F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") != float("inf"))
    total = F.aggregate("_centroids", F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["count"], F.lit(0)))
    hist_ok = (
        F.coalesce(F.col("_shape_ok"), F.lit(False))
        & F.forall("_centroids", lambda c: c["count"].isNotNull() & c["value"].isNotNull())
        & (F.col("_declared").isNull() | (F.col("_declared") == total))
        & (F.col("_has_owner") | F.col("_declared").isNotNull())
    )
    span_ok = F.col("_second_last").rlike(INTEGER) & F.col("_last").rlike(NUMBER)
    reason = (
        F.when(
            F.col("_kind") == "histogram",
            F.when(~F.col("_balanced"), "bad_name")
            .when(~hist_ok, "bad_histogram")
            .when(F.col("_has_owner") & bad_name, "bad_name")
            .when(F.col("_has_owner") & ~F.col("_has_source"), "missing_source")
            .when(~F.col("_tags_ok"), "invalid_tag"),
        )
        .when(
            F.col("_kind") == "span",
            F.when(bad_name, "bad_name")
            .when(~F.coalesce(span_ok, F.lit(False)), "bad_span")
            .when(~F.col("_has_source"), "missing_source")
            .when(~F.col("_tags_ok"), "invalid_tag"),
        )
        .otherwise(
            F.when(F.col("_size") < 3, "too_few_fields")
            .when(bad_name, "bad_name")
            .when(~finite, "invalid_value")
            .when(~F.col("_has_source"), "missing_source")
            .when(~F.col("_tags_ok"), "invalid_tag")
        )
    )
    judged = _bind(
        typed,
        [
            *keep, "_kind", "_line", "_stamp", "_raw_name", "_all_tags", "_value", "_centroids", "_declared",
            "_granularity", "_last", "_second_last",
        ],
        drop_reason=reason,
    ).withColumn("record_type", F.when(F.col("drop_reason").isNull(), F.col("_kind")).otherwise("error"))

    # 5. public columns
    def only(kind: str, expr: Column) -> Column:
        return F.when(F.col("record_type") == kind, expr)

    named = F.regexp_replace(unescape(F.col("_raw_name")), "^[∆Δ]", "")
    is_point = F.col("record_type").isin("metric", "histogram")
    shaped = judged.select(
        *keep,
        F.col("record_type"),
        F.when(is_point, named).alias("metric"),
        only("metric", F.col("_value")).alias("value"),
        F.when(is_point, F.col("_stamp").try_cast("bigint")).alias("ts"),
        F.when(F.col("drop_reason").isNull(), _source(F.col("_all_tags"))).alias("source"),
        F.when(F.col("drop_reason").isNull(), _own_tags(F.col("_all_tags"))).alias("tags"),
        F.when(is_point, F.coalesce(unescape(F.col("_raw_name")).rlike("^[∆Δ]"), F.lit(False))).alias("is_delta"),
        only("histogram", F.col("_granularity")).alias("granularity"),
        only(
            "histogram",
            F.coalesce(
                F.col("_declared"),
                F.aggregate("_centroids", F.lit(0).cast("bigint"), lambda a, c: a + c["count"]),
            ),
        ).alias("hist_count"),
        only("histogram", F.col("_centroids")).alias("centroids"),
        only("span", unescape(F.col("_raw_name"))).alias("operation"),
        only("span", F.col("_second_last").try_cast("bigint")).alias("start_ms"),
        only("span", F.floor(F.col("_last").try_cast("double")).try_cast("bigint")).alias("duration_ms"),
        F.octet_length("_line").alias("line_length"),
        F.col("drop_reason"),
        only("error", F.col("_line")).alias("error_text"),
    )
    if plain:
        fast = F.col(FAST)
        is_fast = fast.isNotNull()

        def either(name: str) -> Column:
            if name in ("record_type", "metric", "value", "ts", "source", "tags", "is_delta", "operation", "start_ms", "duration_ms"):
                return F.when(is_fast, fast[name]).otherwise(F.col(name)).alias(name)
            if name in (*others, "line_length"):
                return F.col(f"`{name}`")
            return F.when(~is_fast, F.col(name)).alias(name)

        shaped = _bind(shaped, [], **{name: either(name) for name in shaped.columns if name != FAST})
        is_point = F.col("record_type").isin("metric", "histogram")
    return shaped.withColumn(
        "family_id",
        F.when(F.col("record_type") == "span", span_family_id(F.col("operation"))).when(
            is_point & F.col("metric").isNotNull(), family_id(F.col("metric"), F.col("tags"))
        ),
    )
