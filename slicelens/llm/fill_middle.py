"""Fill-in-middle: cut each text twice between its lines and put the middle last.

The lines of a text are the links of an indexable skip list. Every lane's link
knows how many lines and how many code points it passes, so going down the
lanes by running sums finds the code point of any line number exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import read
from slicelens.llm.registry import query
from slicelens.llm.words import mixed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are cut, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def line_widths(text: str) -> np.ndarray:
    """Code points of each line with its line feed; text after the last line feed is a line too."""
    widths = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


class SkipList:
    """Units in order under express lanes; one unit in four of a lane starts a link of the next."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        # Lane 0 links every unit to the next; a lane holds (down, units, points) a link.
        down, units, points = np.arange(self.size), np.ones(self.size, np.int64), widths
        self.lanes = [(down, units, points)]
        coins = mixed(np.arange(1, self.size + 1, dtype=np.uint64))
        while len(units) > 4:
            tall = coins & np.uint64(3) == 0
            tall[0] = True  # every lane starts at the head
            down = np.flatnonzero(tall)
            units, points = np.add.reduceat(units, down), np.add.reduceat(points, down)
            self.lanes.append((down, units, points))
            coins = coins[down] >> np.uint64(2)

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        at = passed = points = 0
        for down, units, widths in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, points, at = passed + int(units[at]), points + int(widths[at]), at + 1
            if passed == rank:
                return points
            at = down[at]
        raise IndexError(rank)


def _turned(rate: int, suffix_first: int):
    def run(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b, share, order in zip(texts, h1, h2, h3, h4, strict=True):
            units = SkipList(line_widths(text)) if text else None
            n = units.size if units else 0
            if not text or share % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                rows.append((n, "plain", None, None, text))
                continue
            first, last = sorted((a % (n + 1), b % (n + 1)))
            i, j = units.points_before(first), units.points_before(last)
            if order % 100 < suffix_first:
                form, out = "spm", f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"
            else:
                form, out = "psm", f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"
            rows.append((n, form, i, j - i, out))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in MADE.split(", ")])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
    rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``doc, n, form, prefix_chars, middle_chars, output``: each row, turned; ``doc`` holds its columns.

    Both cuts and the form follow from the sha256 of ``seed:key`` alone, so
    reruns and repeated rows agree. A null text counts as empty, a null key as
    an empty one. Texts that are empty, hold one of the three marks, or are
    left out by ``rate`` stay as they are (form ``plain``, null widths).
    Whole texts are cut, however long; rows and other columns all stay, under
    ``doc``, so that no name can clash. An empty table gives an empty table.
    """
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"doc.`{key}`").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    turned = F.pandas_udf(_turned(rate, suffix_first), MADE)
    whole = F.coalesce(F.col(f"doc.`{text}`").cast("string"), F.lit(""))
    return doc.select("doc", turned(whole, *parts).alias("made")).select("doc", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was made of it; DataFrame functions only."""

    def between(first: str, second: str, third: str) -> list[Column]:
        head = F.substring_index(output, second, 1)
        rest = F.substring(output, F.length(head) + len(second) + 1, F.length(output))
        middle = F.substring_index(rest, third, 1)
        tail = F.substring(rest, F.length(middle) + len(third) + 1, F.length(rest))
        return [F.substring(head, F.lit(len(first) + 1), F.length(head)), middle, tail]

    prefix, suffix, middle = between(PREFIX, SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(SUFFIX, PREFIX, MIDDLE)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
num AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
part AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
      OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM num)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m)
    ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM part
"""


@query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark, folder):
    """Every document turned, with digests of what was made and of the text read back from it."""
    made = fill_in_middle(read(spark, folder, "documents"))
    return made.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
