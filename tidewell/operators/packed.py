"""Several values packed in one field (problem 5).

Ordinary characters are masked, which leaves the *delimiter skeleton* of a field: one code per token, where a
run of ordinary words is ``W`` and a single word ``w``. How a field divides depends on its skeleton alone, so the
rule is worked out once per distinct skeleton and joined back; names are then cut out by token position with
built-in functions. Nothing reaches across the elements of a list, so each element has a skeleton of its own: their
number hardly grows with the rows, however long the lists are. Elements of one record are put together again at the end.

Nulls, empty fields and empty parts give no row and take no position. Texts are read whole, whatever their
length. Repeated rows each give their names. Empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.shared import buckets, kept

#: Characters that divide, those that enclose, and horizontal white space.
COMMAS, SEMICOLONS, BARS, BULLETS, QUOTES = ",，、", ";；", "|｜", "•‣◦∙●▪", "\"'“”‘’"
_BLANK_CODES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x0B, 0x0C]
_LINE_CODES = [0x09, 0x0A, 0x0D, 0x85, 0x2028, 0x2029]
_BLANK = r" \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\x0B\x0C"
_LINE = r"\t\n\r\u0085\u2028\u2029"
_STOP = rf"{_BLANK}{_LINE}{COMMAS}{SEMICOLONS}{BARS}{BULLETS}&\"“”‘’'()（）"
_END = rf"(?=[{_STOP}]|$)"
_AND, _SUFFIX = rf"(?i:and){_END}", rf"(?:(?i:[js]r\.?)|III){_END}"
_SLASH = rf"(?<=[{_BLANK}{_LINE}])/(?=[{_BLANK}{_LINE}])"
_WORD = rf"(?:[^{_STOP}]|(?<=[\p{{L}}\p{{N}}])['’](?=[\p{{L}}\p{{N}}]))+"
_RUN = rf"(?!{_AND}|{_SUFFIX}){_WORD}(?:[{_BLANK}]+(?!{_AND}|{_SUFFIX}|/[{_BLANK}{_LINE}]){_WORD})*"
_TOKEN = rf"[{_BLANK}]+|&amp;|{_SLASH}|{_AND}|{_SUFFIX}|{_RUN}|[\s\S]"
_LEADING_BY = rf"^[{_BLANK}{_LINE}]*[Bb][Yy](?::|(?=[{_BLANK}{_LINE}])|$)"

SPLIT_PLAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("quote", T.StringType())]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _code(token: Column) -> Column:
    first, whole = F.substring(token, 1, 1), F.lower(token)
    single = F.length(token) == 1
    return (
        F.when(first.isin(*[" ", *(chr(c) for c in _BLANK_CODES)]), " ")
        .when(single & first.isin(*COMMAS), ",")
        .when(single & first.isin(*(SEMICOLONS + BARS + BULLETS + "&/"), *(chr(c) for c in _LINE_CODES)), "|")
        .when(whole.isin("&amp;", "and"), "|")
        .when(whole.isin("jr", "jr.", "sr", "sr.") | (token == "III"), "J")
        .when(single & first.isin(*QUOTES, "(", ")"), first)
        .when(single & (first == "（"), "(")
        .when(single & (first == "）"), ")")
        .when(token.contains(" ") | token.rlike(rf"[{_BLANK}]"), "W")
        .otherwise("w")
    )


def skeleton(parts: Column) -> Column:
    """One code per token: `` `` blank, ``,`` comma, ``|`` other delimiter, ``J`` a suffix such as Jr., ``w``/``W`` one/more words; quotes and parentheses stay."""
    return F.array_join(F.transform(parts, _code), "")


def divide(code: str) -> list[tuple[int, int, str]]:
    """The names of a skeleton as (first token, number of tokens, enclosing quote or '')."""
    closing, end = {"“": "”", "‘": "’", '"': '"', "'": "'"}, len(code)
    parts: list[tuple[int, int, str, str]] = []  # first, end, quote, delimiter after it
    at = 0
    while at <= end:
        first = at
        while first < end and code[first] == " ":
            first += 1
        if first < end and code[first] in closing:
            quote, close = closing[code[first]], first + 1
            while close < end and (code[close] != quote or code[close + 1 : close + 2] == quote):
                close += 2 if code[close] == quote else 1
            after = close + 1
            while after < end and code[after] == " ":
                after += 1
            if close < end and (after == end or code[after] in ",|"):
                parts.append((first + 1, close, quote, code[after : after + 1]))
                at = after + 1
                continue
        stop = first
        while stop < end and code[stop] not in ",|":
            if code[stop] == "(" and (shut := code.find(")", stop)) > 0:
                stop = shut
            stop += 1
        last = stop
        while last > first and code[last - 1] == " ":
            last -= 1
        parts.append((first, last, "", code[stop : stop + 1]))
        at = stop + 1
    out, k = [], 0
    while k < len(parts):
        first, last, quote, then = parts[k]
        body, paired = code[first:last], False
        while not quote and body and then == "," and k + 1 < len(parts):
            nxt = parts[k + 1]
            more = "" if nxt[2] else code[nxt[0] : nxt[1]]
            if more == "J":
                paired = True
            elif body == "w" and not paired and any(c in "wWJ" for c in more):
                paired = True
            else:
                break
            last, then, body, k = nxt[1], nxt[3], code[first : nxt[1]], k + 1
        if any(c in "wWJ" for c in body):
            out.append((first, last - first, quote))
        k += 1
    return out


@F.pandas_udf(SPLIT_PLAN)
def _plan(codes: pd.Series) -> pd.Series:
    return codes.map(lambda code: [{"start": a, "length": n, "quote": q} for a, n, q in divide(code)])


def split_packed(rows: DataFrame, keys: list[str], field: str, name: str = "author_name") -> DataFrame:
    """One row per name: ``keys``, pos (from 1, in written order) and ``name``.

    ``field`` is an array of strings, the elements of one packed value (one element for a plain string). The table of
    rules, one row per distinct skeleton, is joined back; the session's size limit for broadcasts decides how, by the
    table's measured size, and a frequent skeleton is split by adaptive execution where it is shuffled.
    """
    clean = F.transform(F.filter(field, lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, _LEADING_BY, ""))
    cut = rows.select(*keys, clean.alias("_parts")).where("size(_parts) > 0").withColumn("_row", F.monotonically_increasing_id())
    cut = cut.select(*keys, "_row", (F.size("_parts") > 1).alias("_several"), F.posexplode("_parts").alias("_no", "_part"))
    cut = cut.select(*keys, "_row", "_several", "_no", tokens(F.col("_part")).alias("_tokens")).withColumn("_code", skeleton(F.col("_tokens"))).where("_code rlike '[wWJ]'")
    cut = kept(cut, "tokens")  # read again below; cutting costs far more than this copy
    codes = cut.select("_code").distinct().repartition(buckets(rows.sparkSession), "_code")
    plans = kept(codes.withColumn("_plan", _plan("_code")), "skeletons")

    def one(p: Column) -> Column:
        text = F.trim(F.regexp_replace(F.array_join(F.slice("_tokens", p["start"] + 1, p["length"]), ""), r"[\s\p{Z}]+", " "))
        return F.when(p["quote"] == "", text).otherwise(F.replace(text, F.concat(p["quote"], p["quote"]), p["quote"]))

    names = lambda several: cut.where(F.col("_several") == several).join(plans, "_code").select(*keys, "_row", "_no", F.transform("_plan", one).alias("_names"))
    together = names(True).groupBy("_row", *keys).agg(F.sort_array(F.collect_list(F.struct("_no", "_names"))).alias("_all"))  # elements of one value only
    together = together.select(*keys, F.flatten("_all._names").alias("_names"))
    out = names(False).select(*keys, "_names").unionByName(together).select(*keys, F.posexplode("_names").alias("pos", name))
    return out.withColumn("pos", F.col("pos") + 1)


def _elements(value: Column) -> Column:
    """The strings of a packed JSON value: a string, an object with a name, or a list of these; a JSON list in a string is its elements."""
    def text(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.when(F.schema_of_variant(F.try_variant_get(x, "$.name", "variant")) == "STRING", F.try_variant_get(x, "$.name", "string")))

    def opened(x: Column) -> Column:
        inner = F.when(x.rlike(r"^\s*\["), F.try_variant_get(F.try_parse_json(x), "$", "array<string>"))
        return F.coalesce(inner, F.array(x))

    several = F.try_variant_get(value, "$", "array<variant>")
    return F.flatten(F.transform(F.filter(F.transform(F.coalesce(several, F.array(value)), text), lambda x: x.isNotNull()), opened))


def author_fields(pwc_raw: DataFrame, jsonld_nodes: DataFrame) -> DataFrame:
    """rec_table, rec_id and packed (array of strings) of every record with a valid JSON document."""
    papers = pwc_raw.select(F.lit("pwc_raw").alias("rec_table"), F.col("record_no").alias("rec_id"), F.try_parse_json("payload").alias("doc"))
    of = lambda key: F.coalesce(_elements(F.try_variant_get("doc", f"$.{key}", "variant")), F.array().cast("array<string>"))
    papers = papers.select("rec_table", "rec_id", F.concat(of("authors"), of("author_names"), of("author_list")).alias("packed"))
    nodes = jsonld_nodes.select(F.lit("jsonld_nodes").alias("rec_table"), F.col("node_id").alias("rec_id"), F.try_parse_json("node").alias("doc")).select("rec_table", "rec_id", of("author").alias("packed"))
    return papers.unionByName(nodes).where("size(packed) > 0")
