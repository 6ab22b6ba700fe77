"""Oversized texts cut into bounded, overlapping pieces at natural boundaries, in SQL array functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.runtime import spread

#: Characters per slab; a long text is sliced into slabs once so that no step walks the whole text again.
SLAB = 8192
#: Pieces that are put together before they join the rest, so that a long text's list isn't copied at every piece.
BLOCK = 512


def boundary_regex(limit: int) -> str:
    """Bounded quantifiers, alternatives by falling boundary strength: each takes the last allowed end after half the limit."""
    reach = f".{{{limit // 2 + 1},{limit}}}"
    ends = [r"(?<=\n\n|\n\r\n)", r"(?<=\n)", r"(?<=[.!?] )", r"(?<= )"]
    return r"(?s)\A(?:" + "|".join(reach + e for e in ends) + f"|.{{{limit}}})"


def split_oversized(rows: DataFrame, limit: int = 750, overlap: int = 80, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, piece_no, start_pos, end_pos) of every text longer than limit characters (code points).

    A piece ends at the strongest boundary in its second half (blank line, line end, sentence end, space, else at limit); the
    next starts after the first space or line end among the overlap characters before that end, else overlap characters before it.
    Null ids and null or short texts give no piece; repeated rows give their pieces once. Each text is a row's own work, linear
    in its length, without shuffle of the text; only the (id, positions) rows are made distinct.
    """
    if not 0 < overlap < limit // 2:
        raise ValueError("overlap must be positive and under half the limit")
    half, n = limit // 2, F.length("_t")
    at = F.lit
    regex = boundary_regex(limit)

    def window(start, count):
        """count characters from start (0-based), out of at most two slabs."""
        k = F.floor(start / at(SLAB)).cast("int")
        two = F.concat(F.element_at("_slabs", k + 1), F.coalesce(F.try_element_at("_slabs", k + 2), at("")))
        return two.substr(start - k * at(SLAB) + 1, count)

    def once(value, body):
        """body(value) with value worked out once, however often body names it."""
        return F.transform(F.array(value), body)[0]

    def placed(state, start, last, end):
        # the characters before the positions end-overlap .. end-1
        gap = F.length(F.regexp_extract(window(end - at(overlap + 1), at(overlap)), r"(?s)\A[^ \n]*", 0))
        after = end - at(overlap) + gap % at(overlap)
        return F.struct(F.when(last, at(-1)).otherwise(after).cast("int").alias("next"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.cast("int").alias("e")))).alias("out"))

    def step(state, _):
        start = state["next"]
        last = F.col("_n") - start <= at(limit)
        end = F.when(last, F.col("_n")).otherwise(start + F.length(F.regexp_extract(window(start, at(limit)), regex, 0)))
        return F.when(start < 0, state).otherwise(once(end, lambda e: placed(state, start, last, e)))

    def block(state, _):
        inner = F.aggregate(F.sequence(at(1), F.least(at(BLOCK), F.col("_most"))), F.struct(state["next"].alias("next"), none.alias("out")), step)
        return F.when(state["next"] < 0, state).otherwise(once(inner, lambda b: F.struct(b["next"].alias("next"), F.concat(state["blocks"], F.array(b["out"])).alias("blocks"))))

    none = F.array().cast("array<struct<s:int,e:int>>")
    empty = F.struct(at(0).alias("next"), F.array().cast("array<array<struct<s:int,e:int>>>").alias("blocks"))
    pieces = F.flatten(F.aggregate(F.sequence(at(0), F.floor(F.col("_most") / at(BLOCK)).cast("int")), empty, block, lambda state: state["blocks"]))
    most = (F.floor(n / at(half + 1 - overlap)) + 1).cast("int")
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).where(F.col("id").isNotNull() & (n > limit))
    return (
        spread(texts)
        .select("id", n.alias("_n"), most.alias("_most"), F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{SLAB}}}"), F.lit(0)).alias("_slabs"))
        .select("id", F.posexplode(pieces).alias("piece_no", "p"))
        .select("id", "piece_no", F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"))
        .distinct()
    )
