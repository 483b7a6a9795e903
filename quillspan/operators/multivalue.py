"""Several values packed in one field, split by delimiter skeletons.

A field is cut into tokens (separators, closed quotes, closed brackets, joining words, name suffixes, ordinary text), each with the blanks after it. The
tokens' classes are its skeleton, in which all ordinary characters are masked. Whether a separator splits depends on its neighbours alone, so a skeleton
falls into units of four classes: the token before, the separator and the two after it. The number of distinct units is fixed however much data there is;
the rule of each is worked out once on the driver, the rules go to every task, and the items are extracted by position. There is neither a join nor a table
that grows. Tokens need a pattern with state (quotes, nested brackets), so this part runs in Arrow batches on the Python workers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and signs that join two values when they stand between blanks; suffixes that belong to the name before them.
JOINERS = ("and", "&", "+", "und", "et", "y")
SUFFIXES = (r"Jr\.?", r"Sr\.?", "II", "III", "IV")
#: Separators: punctuation but for full stops, hyphens, apostrophes, quotes, brackets and the joining signs.
_SEP = r"[[\p{P}|\n\r\u2028\u2029]--[.\-\u2010\u2011'\u2019\u2018\"()&+]]"
_SPACE = r"[ \t\n\x0b\f\r]"
_JOIN = "(?:" + "|".join(map(regex.escape, JOINERS)) + ")"
_WORD = rf"(?:(?!{_SEP})[[^\s\p{{Z}}\"()]])++"
_GAP = r"[[\s\p{Z}]--[\n\r\u2028\u2029]]"
#: One token with the blanks after it; the group's name is its class, an unnamed one is ordinary (x).
TOKEN = regex.compile(
    rf"(?:(?P<Q>\"(?:[^\"]|\"\")*+\")|(?P<p>{_SEP})|[\"()]|(?P<w>(?<={_SPACE}){_JOIN}(?={_SPACE}))|(?P<s>(?:{'|'.join(SUFFIXES)})(?=[\s\")]|\Z|{_SEP}))|{_WORD}(?:[\p{{Z}}\t]++(?!{_JOIN}{_SPACE}){_WORD})*+){_GAP}*+",
    regex.V1 | regex.DOTALL,
)
_GAPS = regex.compile(rf"{_GAP}*+", regex.V1)
#: Classes: separator, joiner, quoted, quoted blanks, closed bracket, suffix, ordinary; before the first and after the last token.
CLASSES, FIRST, LAST = "pwQERsx", "^", "$"


def splits(unit: str) -> bool:
    """Whether the separator of a unit (class before, separator, two classes after) splits: all do, but for punctuation after a name that a suffix or a remark
    in brackets follows, the suffix being the last of its item."""
    before, self, after, then = unit
    named = before not in "pw" + FIRST
    return self == "w" or self == "p" and not (named and (after == "R" or after == "s" and then in "pwR" + LAST))


#: The units whose separator splits, of all there can be.
SPLITTING = frozenset(u for u in map("".join, itertools.product(FIRST + CLASSES, "pw", CLASSES + LAST, CLASSES + LAST)) if splits(u))


def _closed(text: str) -> dict[int, int]:
    """Opening bracket -> its closing one, in one pass."""
    out, opened = {}, []
    for m in regex.finditer(r"[()]", text):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.start()
    return out


def tokens(text: str) -> tuple[list[str], str]:
    """The tokens of a trimmed text and its skeleton. What is never closed is ordinary text."""
    parts, classes, at = [], [], 0
    closed = _closed(text) if "(" in text else {}
    while at < len(text):
        if at in closed:
            end = _GAPS.match(text, closed[at] + 1).end()
            parts.append(text[at:end])
            classes.append("R")
        else:
            m = TOKEN.match(text, at)
            end = m.end() if m else at + 1
            parts.append(text[at:end])
            c = (m and m.lastgroup) or "x"
            classes.append("E" if c == "Q" and not m["Q"][1:-1].strip() else c)
        at = end
    return parts, "".join(classes)


def items_of(text: str) -> list[str]:
    """The values of a field, by its skeleton's units."""
    text = text.strip()
    parts, skeleton = tokens(text)
    padded, n = FIRST + skeleton + LAST + LAST, len(parts)
    ends = [i for i, c in enumerate(skeleton) if c in "pw" and padded[i : i + 4] in SPLITTING]
    out, start = [], 0
    for end in (*ends, n):
        if end - start == 1 and skeleton[start] in "QE":
            item = parts[start].strip()[1:-1].replace('""', '"').strip()
        else:
            item = "".join(parts[start:end]).strip()
        if item:
            out.append(item)
        start = end + 1
    return out


def split_values(df: DataFrame, key: str, fields: list[str], at_least: int = 1) -> DataFrame:
    """key, field_name, pos (from 1), item: one row per value of each field that holds at least ``at_least`` values.

    Separators are punctuation (but full stops, hyphens and apostrophes), line breaks and a joining word or sign between blanks; within
    double quotes or brackets they are content, and a quote or bracket that is never closed is content itself. Items are trimmed; quotes
    around a whole item go and doubled ones inside become single; a remark in brackets or a generational suffix after a separator
    stays with the name before it. Empty entries don't count. A null, blank or empty field gives no rows. Rows with equal key and
    fields count once; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("k"), *[F.col(f).cast("string").alias(f"v{j}") for j, f in enumerate(fields)]).distinct()
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType), T.StructField("field_name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, field, pos, item = [], [], [], []
            for j in range(len(fields)):
                for r, text in enumerate(b.column(1 + j).to_pylist()):
                    found = items_of(text) if text else []
                    if len(found) >= at_least:
                        take += [r] * len(found)
                        field += [j] * len(found)
                        pos += range(1, len(found) + 1)
                        item += found
            names = pa.array(fields, pa.string()).take(pa.array(field, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), names, pa.array(pos, pa.int64()), pa.array(item, pa.string())], [key, "field_name", "pos", "item"])

    return rows.mapInArrow(run, schema)
