"""Fill-in-middle: texts cut at token boundaries into prefix, middle and suffix, which are put in another order behind marks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy, unused

#: The marks before prefix, suffix and middle. A text that holds one of them stays as it is.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where the tokens of a text end: after each run of other characters, white space (\\x20 and \\x09-\\x0D) being the next token's,
    and at the text's end."""
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    inside = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(inside, len(codes)) if len(codes) else inside


def parts(text: str, ranks: tuple[int, int]) -> tuple[int, str, str, str]:
    """Number of tokens n, and the text up to the smaller rank's token, on to the larger's, and the rest; ranks count modulo n + 1."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = boundaries(codes)
    n = len(ends)
    lo, hi = (int(ends[k - 1]) if k else 0 for k in sorted(r % (n + 1) for r in ranks))
    piece = lambda a, b: codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")
    return n, piece(0, lo), piece(lo, hi), piece(hi, len(codes))


def rearranged(text: str, ranks: tuple[int, int], form: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, the form after all, code points of prefix and middle (None if plain), and the output."""
    n, prefix, middle, suffix = parts(text, ranks)
    if form == PLAIN or not text or any(mark in text for mark in MARKS):
        return n, PLAIN, None, None, text
    p, s, m = MARKS
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == SPM else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, len(prefix), len(middle), out


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. No text with marks is cut, so the first of each mark is the one put in."""
    p, s, m = MARKS
    at = {mark: F.locate(mark, output) for mark in MARKS}
    between = lambda a, b: F.substring(output, at[a] + 3, at[b] - at[a] - 3)
    middle = F.substring(output, at[m] + 3, F.length(output))
    return F.when(form == PSM, F.concat(between(p, s), middle, between(s, m))).when(form == SPM, F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight hex digits of sha256("seed:doc_id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _transform(batches, schema: pa.Schema):
    for batch in batches:
        for piece in pieces(batch, "text", 4 << 20):
            ids, texts, first, second, forms = (piece.column(c).to_pylist() for c in ("doc_id", "text", "first", "second", "form"))
            made = [rearranged(*row) for row in zip(texts, zip(first, second), forms)]
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip((ids, *zip(*made)), schema)], schema=schema)
    tidy()


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output for every document.

    rate percent of the texts are cut, spm_rate percent of those into suffix, prefix, middle, the others into prefix, suffix, middle;
    a text's draws follow from the seed and its doc_id alone (a null doc_id draws as an empty one), so repeated rows give repeated
    results. Null texts are empty; an empty text and one that holds a mark stay plain, their prefix_chars and middle_chars are null.
    Prefix, middle or suffix can be empty. Texts of any length are cut whole; an empty table gives an empty result; further columns
    are dropped. No shuffle: each task reads its texts in slices of 4 MB (a longer text by itself).
    """
    h = draws(seed, F.col("doc_id"))
    form = F.when(h[2] % 100 >= rate, PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM)
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h[0].alias("first"), h[1].alias("second"), form.alias("form"))
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("doc_id"), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        yield from _transform((b for part in ([first], batches) for b in part), schema)

    return given.mapInArrow(run, ddl)


def digests(docs: DataFrame) -> DataFrame:
    """transform(), with SHA-256 of each output and of the text restored from it."""
    made = transform(docs)
    name = unused(made, "back")
    return made.withColumn(name, restored(F.col("output"), F.col("form"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col(name).cast("binary"), 256).alias("restored_sha256"),
    )
