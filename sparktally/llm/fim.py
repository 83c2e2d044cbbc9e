"""Fill-in-middle: cuts each text at two unit boundaries and writes its parts in another order between markers.

A unit is a word with the white space before it, or white space at the text's end. A text is read in fixed blocks; a
Fenwick tree over the blocks holds their units and code points. To find a cut, a binary-lifting descent takes whole
blocks while they hold fewer units than wanted, and only the block where it ends is looked into. Python sees texts and
gives numbers; the parts are put together on the JVM's side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 4096
#: Markers of the prefix, the suffix and the middle.
PRE, SUF, MID = "<P>", "<S>", "<M>"


def unit_ends(text: str, start: int, stop: int) -> np.ndarray:
    """For each character of ``text[start:stop]`` whether a unit ends with it."""
    code = np.frombuffer(text[start : stop + 1].encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    size = min(stop, len(text)) - start
    last = np.ones(size, bool)
    last[: len(code) - 1] = blank[1 : size + 1]
    ends = ~blank[:size] & last
    if stop >= len(text) and size:
        ends[-1] = True  # a word's last letter, or white space at the end
    return ends


class BlockTree:
    """A Fenwick tree over a text's blocks: node i holds the sums of the (i & -i) blocks that end with block i."""

    def __init__(self, text: str, block: int = BLOCK, at_once: int = 256) -> None:
        self.text, self.block, counts = text, block, []
        for a in range(0, len(text), block * at_once):  # a long text is never held as numbers whole
            ends = unit_ends(text, a, min(len(text), a + block * at_once))
            counts.append(np.add.reduceat(ends, np.arange(0, len(ends), block), dtype=np.int64))
        own = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.n = int(own.sum())
        width = np.full(len(own), block, np.int64)
        if len(own):
            width[-1] = len(text) - block * (len(own) - 1)
        self.units, self.chars = [0, *own.tolist()], [0, *width.tolist()]
        for i in range(1, len(self.units)):
            up = i + (i & -i)
            if up < len(self.units):
                self.units[up] += self.units[i]
                self.chars[up] += self.chars[i]

    def cut(self, units: int) -> int:
        """How many code points the first ``units`` units have."""
        if not units:
            return 0
        at, chars, step = 0, 0, 1 << (len(self.units) - 1).bit_length()
        while step:
            if at + step < len(self.units) and self.units[at + step] < units:
                at += step
                units -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        return chars + int(np.flatnonzero(unit_ends(self.text, chars, min(len(self.text), chars + self.block)))[units - 1]) + 1


def cuts(texts: list[str | None], first: list[int], second: list[int]) -> pd.DataFrame:
    """(n, a, b): the units of each text, and the code points before its lower and its higher cut."""
    rows = []
    for text, x, y in zip(texts, first, second, strict=True):
        tree = BlockTree(text or "")
        lo, hi = sorted((x % (tree.n + 1), y % (tree.n + 1)))
        rows.append((tree.n, tree.cut(lo), tree.cut(hi)))
    return pd.DataFrame(rows, columns=["n", "a", "b"], dtype="int64")


def draw(seed: str, k: int, doc_id: str = "doc_id") -> Column:
    """The k-th group (from 1) of eight hex digits of the hash of seed and id, as a number. A null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, seed: str = "42", plain_share: int = 50, spm_share: int = 80) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    form: ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), by hash of the id in per cent
    (``plain_share`` of all stay plain; ``spm_share`` of the others are spm). Null or empty texts and those that hold a
    marker are plain; a null text's output is empty. prefix_chars, middle_chars: null if plain. Texts of any length are
    cut whole. Repeated rows each get their row, rows of one id the same draws. Other columns, whatever their names, are
    ignored. No rows: none.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in batches:
            yield cuts(texts.tolist(), first.tolist(), second.tolist())

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("at", F.pandas_udf(run, "n long, a long, b long", F.PandasUDFType.SCALAR_ITER)("text", draw(seed, 1), draw(seed, 2)))
    marked = F.contains("text", F.lit(PRE)) | F.contains("text", F.lit(SUF)) | F.contains("text", F.lit(MID))
    plain = (F.col("text") == "") | marked | (draw(seed, 3) % 100 >= plain_share)
    form = F.when(plain, "plain").when(draw(seed, 4) % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "at.n", "at.a", "at.b", form.alias("form"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PRE), prefix, F.lit(SUF), suffix, F.lit(MID), middle)).otherwise(F.concat(F.lit(SUF), suffix, F.lit(PRE), prefix, F.lit(MID), middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that rearrange() had, from its output and form alone. A cut text holds no marker, so each occurs once."""
    out = F.col(output)
    middle = F.substring_index(out, MID, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(out, second, 1)
        return F.substring(head, F.lit(len(first) + 1), F.length(head)), F.substring_index(F.substring_index(out, second, -1), MID, 1)

    (p, s), (s2, p2) = parts(PRE, SUF), parts(SUF, PRE)
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(p, middle, s)).otherwise(F.concat(p2, middle, s2))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rearrange(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: The same rows in DuckDB, with all units of a text in one list. The restored text is the text.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 50 THEN 'plain' WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
