"""Text quality statistics of each document, and its kind: prose, list, table or junk.

Structure comes from the layout: a table's delimiters or column gaps align vertically, and its rows are as long as those near
them; a list's lines begin with markers, or are short lines without sentence ends.  Between lists without markers and
hard-wrapped prose the sentences per line decide together with the periodicity of the indentation, which nested lists have, and
the autocorrelation of the line lengths, which wrapped prose has.  Word, symbol, punctuation and repetition ratios, words common
in any language of the corpus, and letters that were read in a wrong encoding decide about junk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import written

LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile(r"\s*(?:[-*+•◦▪‣→►–—·o]|\[[ xX✓]?\]|[☐☑✓✗]|\(?\d{1,3}[.):]|\(?[^\W\d_][.)]|\(?[ivxIVX]{1,5}[.)])[ \t ]+\S")
STOP = re.compile(r"[.!?؟。！？…][\"'”’»)\]]*(?=\s|$)")
ENDS = re.compile(r"[.!?؟。！？…:;؛][\"'”’»)\]*_]*\s*$")
URL = re.compile(r"\s*(?:https?://|www\.)\S+\s*$")
GAP = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
SEPARATORS = "|/›»>·•"
MENU = re.compile(r"(?<=\S) +([|/›»>·•]) +(?=\S)|(?<=\S) {2,}(?=\S)")
RULE = re.compile(r"[\s|+:=_.*~#-]+$")
#: UTF-8 read as Latin-1 or Windows-1252: a lead byte of two or three, then as many bytes that go on.
_GOES_ON = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
BROKEN = re.compile(f"[\xc3-\xdf]{_GOES_ON}|[\xe0-\xef]{_GOES_ON}{{2}}")
FOREIGN = re.compile(r"[^\W\d_\x00-\x7f]")
#: Scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")

COLUMNS = {
    "n_chars": "bigint", "n_words": "int", "n_lines": "int", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "space_ratio": "double",
    "ending_lines": "double", "common_words": "double", "distinct_words": "double", "distinct_lines": "double", "sentences_per_line": "double", "marked_lines": "double", "marked_words": "double",
    "aligned_lines": "double", "delimiter": "string", "cell_lines": "double", "one_separator": "double", "indent_period": "double", "length_autocorrelation": "double", "mean_line_words": "double", "url_lines": "double",
    "broken_letters": "double", "unspaced_letters": "double",
}


def common_words(texts: DataFrame, text_col: str, lang_col: str | None = None, share: float = 0.002, top: int = 20_000) -> list[str]:
    """The words that at least the part ``share`` of the texts of some language hold (3 texts at least), counted over all texts.

    A language is a value of ``lang_col``, null one of its own; without the column all texts are one.  Each task sends its own
    counts.  Should more than ``top`` words qualify, those with the largest part count; ties go to the word that sorts first.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            langs, words = zip(*counts) if counts else ((), ())
            columns = [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for b in batches:
            for t, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    counts.update({(of, w) for w in WORD.findall(t.lower())})
                    counts[of, None] += 1  # the texts of the language
            if len(counts) > 500_000:
                yield sent()
                counts = Counter()
        yield sent()

    counted = texts.select(F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, "lang string, word string, n bigint")
    counted = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("word is null or n >= 3"), "word-counts")
    sizes = counted.where("word is null").select(F.coalesce("lang", F.lit("")).alias("of"), F.col("n").alias("size"))
    found = counted.where("word is not null").withColumn("of", F.coalesce("lang", F.lit(""))).join(sizes, "of")
    found = found.select("word", (F.col("n") / F.col("size")).alias("part")).where(F.col("part") >= share)
    found = found.groupBy("word").agg(F.max("part").alias("part")).orderBy(F.desc("part"), "word").limit(top)
    return [r["word"] for r in found.collect()]


def _alignment(lines: list[str]) -> tuple[float, str]:
    """The largest share of lines whose delimiters align, and the delimiter; rules between rows count with the rows.

    Delimited cells align if the lines have the same number of one delimiter; padded columns if their gaps begin or end
    at the same places.
    """
    rows = [x.strip() for x in lines]
    body = [x for x in rows if not RULE.match(x)] or rows
    n, best = len(body), (0.0, "")
    if n < 2:
        return best
    for d, least in (("|", 2), ("\t", 1), (";", 1), (",", 1)):
        counts = [x.count(d) for x in body]
        if not any(counts):
            continue
        if d == "|" and sum(c > 0 for c in counts) and not any(x.startswith("|") for x in body):
            least = 1
        c, k = Counter(c for c in counts if c >= least).most_common(1)[0] if any(c >= least for c in counts) else (0, 0)
        if d in ",;" and k:  # cells are short, and a row isn't a sentence
            same = [x for x, y in zip(body, counts) if y == c and not STOP.search(x) and max(len(p.split()) for p in x.split(d)) <= 8]
            k = len(same)
        best = max(best, (k / n, d), key=lambda p: p[0])
    raw = [x.rstrip() for x in lines if not RULE.match(x.strip())] or lines
    spaced = [x for x in raw if "  " in x or "\t" in x]
    if len(spaced) >= 0.6 * len(raw):
        edges = [{(e, k) for m in GAP.finditer(x) for k, e in enumerate(m.span())} for x in spaced]
        usual = {e for e, k in Counter(e for s in edges for e in s).items() if k >= 0.6 * len(raw)}
        k = sum(bool(s & usual) for s in edges)
        best = max(best, (k / len(raw), "gap"), key=lambda p: p[0])
    return best


def _separators(lines: list[str]) -> tuple[float, float]:
    """The share of lines made of short cells, and among these the share of the most usual separator: menus mix theirs."""
    kinds = Counter()
    for x in lines:
        if "  " not in x and not any(c in x for c in SEPARATORS):
            continue
        found = [m.group(1) or "gap" for m in MENU.finditer(x.strip())]
        if found and len(WORD.findall(x)) <= 4 * (len(found) + 1):
            kinds[Counter(found).most_common(1)[0][0]] += 1
    n = sum(kinds.values())
    return (n / len(lines), kinds.most_common(1)[0][1] / n) if n else (0.0, 0.0)


def _autocorrelation(x: np.ndarray) -> float:
    """Largest autocorrelation of a sequence at lags 1 to 3; 1 for a constant one, 0 for fewer than four values."""
    if len(x) < 4:
        return 0.0
    y = x - x.mean()
    v = float(y @ y)
    return 1.0 if v == 0 else max(float(y[k:] @ y[:-k]) / v for k in (1, 2, 3) if k < len(x))


def measure(text: str | None, common: frozenset[str]) -> dict:
    """The statistics of one whole text; all null for a null one, zeros where a ratio has no base (empty and blank texts)."""
    if text is None:
        return dict.fromkeys(COLUMNS)
    lines = [x for x in LINE.split(text) if x.strip()]
    words = WORD.findall(text.lower())
    n, k = max(1, len(text)), len(lines)
    letters, digits, spaces = sum(map(len, words)), sum(map(len, DIGITS.findall(text))), len(text) - sum(map(len, text.split()))
    marked = [bool(MARK.match(x)) for x in lines]
    per_line = [len(WORD.findall(x)) for x in lines]
    aligned, delimiter = _alignment(lines)
    cells, one = _separators(lines)
    indent = np.array([len(x) - len(x.lstrip()) for x in lines], float)
    per = lambda a, b: a / b if b else 0.0
    broken = len(BROKEN.findall(text)) if not text.isascii() else 0
    foreign = len(FOREIGN.findall(BROKEN.sub("", text))) if broken else 0
    unspaced = len(UNSPACED.findall(text)) if not text.isascii() else 0
    return {
        "n_chars": len(text), "n_words": len(words), "n_lines": k, "mean_word_length": per(letters, len(words)),
        "symbol_ratio": (len(text) - letters - digits - spaces) / n, "digit_ratio": digits / n, "space_ratio": spaces / n,
        "ending_lines": per(sum(bool(ENDS.search(x)) for x in lines), k), "common_words": per(sum(w in common for w in words), len(words)),
        "distinct_words": per(len(set(words)), len(words)), "distinct_lines": per(len({x.strip() for x in lines}), k),
        "sentences_per_line": per(len(STOP.findall(text)), k), "marked_lines": per(sum(marked), k), "marked_words": per(sum(p for p, m in zip(per_line, marked) if m), sum(per_line)),
        "aligned_lines": aligned, "delimiter": delimiter, "cell_lines": cells, "one_separator": one, "indent_period": _autocorrelation(indent) if len(set(indent)) > 1 else 0.0, "length_autocorrelation": _autocorrelation(np.array([len(x) for x in lines], float)),
        "mean_line_words": per(sum(per_line), k), "url_lines": per(sum(bool(URL.match(x)) for x in lines), k),
        "broken_letters": per(broken, broken + foreign) if 50 * broken >= len(words) else 0.0, "unspaced_letters": min(1.0, per(unspaced, letters)),
    }


def is_table(s: dict) -> bool:
    """Rows whose cells align; where they align in part, rows as long as their neighbours speak for a table as well."""
    aligned = s["aligned_lines"] + 0.15 * max(0.0, s["length_autocorrelation"])
    return aligned >= 0.6 and s["aligned_lines"] >= 0.45 and s["n_lines"] >= 3 and s["sentences_per_line"] < 0.35


def is_bare_list(s: dict) -> bool:
    """Short lines with few sentences: a list without markers, unless the lengths of its lines go on like those of wrapped prose.

    Each sentence per line, and regular line lengths, speak against a list, a periodic indentation for it.
    """
    for_list = 0.3 - s["sentences_per_line"] + 0.1 * (s["indent_period"] > 0.3) - 0.2 * max(0.0, s["length_autocorrelation"])
    return for_list > 0 and s["n_lines"] >= 3 and s["mean_line_words"] <= 12


def kind_of(s: dict) -> str | None:
    """prose, list, table or junk by the statistics; null for null, empty and blank texts."""
    if not s["n_lines"]:
        return None
    words, lines, unspaced = s["n_words"], s["n_lines"], s["unspaced_letters"] > 0.3
    if words < 2 and not unspaced or s["url_lines"] > 0.5:
        return "junk" if s["n_chars"] >= 12 or s["url_lines"] > 0.5 else "prose"
    long_tokens = s["space_ratio"] < 0.03 and s["n_chars"] > 80 and not unspaced  # encoded data and code without spaces
    table = is_table(s)
    unknown = words >= 5 and not unspaced and s["common_words"] < (0.2 if table else 0.4)
    if unknown and s["sentences_per_line"] == 0 or long_tokens and not table:
        return "junk"  # strings that are words of no language, or not written as words; a language that is rare here has sentences
    if s["broken_letters"] > 0.5:
        return "junk"  # read in a wrong encoding
    if s["cell_lines"] >= 0.7 and s["one_separator"] < 0.8 and lines >= 3:
        return "junk"  # a menu
    scattered = s["mean_word_length"] < 1.9 and not unspaced and not (table and s["delimiter"] != "gap")
    if scattered or (words >= 12 and s["distinct_words"] < 0.12) or (lines >= 5 and s["distinct_lines"] < 0.25):
        return "junk"
    if s["marked_lines"] > 0.5 and s["marked_words"] > 0.4 and lines >= 2:
        return "list"
    if table:
        return "table"
    if s["symbol_ratio"] > 0.3:
        return "junk"
    if is_bare_list(s):
        return "list"
    if s["sentences_per_line"] == 0 and words >= 15 and s["mean_line_words"] > 12 and not unspaced:
        return "junk"  # a run of words without a sentence
    return "prose"


def statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """id_col, the COLUMNS, and kind: one row for each row of ``df``.

    Null texts have null statistics and kind; empty and blank ones zeros and a null kind.  Ids may be null or repeat; other
    columns but the label of the language aren't read.  The whole text is measured, however long.
    """
    common = frozenset(common_words(df, text_col, lang_col))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", kind string"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t, common) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[c] for r in rows], arrow[t]) for c, t in COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([kind_of(r) for r in rows], pa.string())], names=["id", *COLUMNS, "kind"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
