"""Run ids: a document's hash and a run's place in it, as one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.arrays import let

# The grammar of a run id.
NAME = r"[A-Za-z0-9_.+-]+"
PATTERN = rf"^([0-9a-f]{{64}}):p(\d+):c(\d+)((?:/x\d+)*)(?:/a(\d+):({NAME}))?(?:/t(\d+))?(?:/y({NAME}))?:o(\d+)(?::g(\d+)-(\d+))?$"
FIELDS = ("source_hash", "page", "part", "xobj_path", "annot_idx", "annot_state", "pattern", "charproc", "byte_offset", "g_start", "g_end")


def encode(source_hash: Column, page: Column, part: Column, offset: Column, xobj_path: Column | None = None, annot_idx: Column | None = None, annot_state: Column | None = None, pattern: Column | None = None, charproc: Column | None = None, g_start: Column | None = None, g_end: Column | None = None) -> Column:
    """The run id; parts that are absent or null leave no trace."""

    path = F.lit("") if xobj_path is None else F.coalesce(F.array_join(F.transform(xobj_path, lambda x: F.concat(F.lit("/x"), x.cast("string"))), ""), F.lit(""))
    tail = [path, _maybe("/a", annot_idx, ":", annot_state), _maybe("/t", pattern), _maybe("/y", charproc)]
    return F.concat(source_hash, F.lit(":p"), page.cast("string"), F.lit(":c"), part.cast("string"), *tail, F.lit(":o"), offset.cast("string"), _maybe(":g", g_start, "-", g_end))


def _maybe(prefix: str, value: Column | None, between: str = "", more: Column | None = None) -> Column:
    """The prefix and the values, or nothing where one of them is null."""
    if value is None:
        return F.lit("")
    values = [value.cast("string")] if more is None else [value.cast("string"), F.lit(between), more.cast("string")]
    return F.coalesce(F.concat(F.lit(prefix), *values), F.lit(""))


# The operators of content streams, and the bytes that end a token.
OPERATORS = (
    "b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EI EMC ET EX f F f* G g gs h i ID j J k K l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \""
).split()
BOUNDARY = r"\x00\t\n\x0c\r ()<>\[\]{}/%"


def resolves(run_id: Column, parts: Column) -> Column:
    """Whether an operator of the part that run_id names starts at its offset; parts: a map of part numbers to their bytes."""

    def at(v: Column) -> Column:
        token = F.regexp_extract(v["body"].substr(v["offset"] + 1, F.length(v["body"])), f"^[^{BOUNDARY}]+", 0)
        starts = (v["offset"] == 0) | v["body"].substr(v["offset"], F.lit(1)).rlike(f"[{BOUNDARY}]")
        return (v["offset"] < F.length(v["body"])) & starts & token.isin(*OPERATORS)

    where = let(decode(run_id), lambda p: F.struct(F.decode(F.try_element_at(parts, p["part"].cast("int")), "ISO-8859-1").alias("body"), p["byte_offset"].cast("int").alias("offset")))
    return F.coalesce(let(where, at), F.lit(False))


def is_valid(run_id: Column) -> Column:
    """Whether all of run_id is in the grammar; a line feed behind it is not."""
    return F.coalesce(run_id.rlike(PATTERN[:-1] + r"\z"), F.lit(False))


def decode(run_id: Column) -> Column:
    """A struct of FIELDS, null for what is no run id; absent parts are null, xobj_path an array."""

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(run_id, PATTERN, i), F.lit(""))

    kinds = dict.fromkeys(("page", "part", "annot_idx", "pattern", "byte_offset", "g_start", "g_end"), "bigint")
    parts = []
    for i, name in enumerate(FIELDS, 1):
        value = F.transform(F.regexp_extract_all(F.regexp_extract(run_id, PATTERN, i), F.lit(r"/x(\d+)"), 1), lambda x: x.cast("bigint")) if name == "xobj_path" else group(i)
        parts.append((value.cast(kinds[name]) if name in kinds else value).alias(name))
    return F.when(is_valid(run_id), F.struct(*parts))
