"""Text cut off by field limits or broken transfers.

One pass over the values looks at the end of each and counts the words before it.  The vocabulary becomes a trie, held as a table
of nodes (prefix, how often a word ends there, how often words go on), so that it can be as large as the corpus asks for.
A value without a proper end was cut if its final token is an unknown proper prefix of known words, if its length is one
at which such ends pile up, or if it breaks off within a sentence; signs of a cut and markup left open decide at once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import written
from .textops import TAG, WORD

SIGN = re.compile(r"(?:…|\.{3}|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\))\s*(?:(?:Continue reading|Read more)\s*(?:→|»|>)?)?$|[\[(](?:truncated|cut|abridged)[\])]$|�$")
END = re.compile(r"[.!?؟。！？۔][\"'”’»)\]*_]*$")
INNER_END = re.compile(r"[^\s\d][.!?؟。۔]\s+\S")
ITEM = re.compile(r"\s*(?:[-*+•→◦▪]|\(?\d{1,3}[.)]|\[[ xX]\])\s+")
HEADING = re.compile(r"\s*#{1,6}\s")
MARKUP = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
OPEN_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|/)?$")
LAST_TOKEN = re.compile(r"[^\W\d_]+$")
ADDRESS_END = re.compile(r"(?:https?://\S+|[^\s@]+@[^\s@]+\.\w+)$")
NUMBER_END = re.compile(r"\S*\d\S*$")

# Elements of HTML that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

SCHEMA = "kind string, id bigint, field string, source string, sure boolean, prose boolean, token string, line string, chars int, bytes int, word string, n bigint"


def markup_left_open(text: str) -> bool:
    """The value ends within a tag, or within an element that it closes elsewhere or opens only once."""
    if "<" not in text:
        return False
    if OPEN_TAG.search(text):
        return True
    stack, closed, opened = [], set(), Counter()
    for m in MARKUP.finditer(text):
        name = m.group(2).lower()
        if name in VOID or m.group(3):
            continue
        if m.group(1):
            closed.add(name)
            if name in stack:
                while stack.pop() != name:
                    pass
        else:
            stack.append(name)
            opened[name] += 1
    return any(name in closed or opened[name] == 1 for name in stack)


def look(text: str) -> tuple[bool, bool, bool, str, str]:
    """(whole, sure, prose, token, line) of the end of a value.

    whole: it has a proper end.  sure: a sign or open markup shows the cut.  Else prose: the last line breaks off within a
    sentence; token: the last run of letters if nothing follows it; line: 128 bits that stand for the letters of the last line
    in lower case ('' for a line without letters).
    """
    text = text.rstrip()
    if not text:
        return True, False, False, "", ""
    if markup_left_open(text):
        return False, True, False, "", ""
    has_markup = text.endswith(">") and bool(TAG.search(text))
    plain = html.unescape(TAG.sub(" ", text) if "<" in text else text).rstrip()
    if SIGN.search(plain):
        return False, True, False, "", ""
    line = plain.rsplit("\n", 1)[-1]
    words = WORD.findall(line)
    letters = "".join(w for w in words if not w.isdigit()).lower()
    letters = letters and xxhash.xxh3_128_hexdigest(letters)
    if not plain or END.search(plain):
        return True, False, False, "", letters
    item = bool(ITEM.match(line) or HEADING.match(line))
    if has_markup or ADDRESS_END.search(plain) or (NUMBER_END.search(plain) and plain.count(" ") < 4):
        return True, False, False, "", letters  # closed markup, an address, a version
    token = LAST_TOKEN.search(plain)
    prose = not item and (bool(INNER_END.search(line)) or len(words) >= 5)
    return False, False, prose, token.group().lower() if token else "", letters


def _pass(values: DataFrame) -> DataFrame:
    """values: id, source, field, value.  Rows of kind end (a value without a proper end), line (a last line, counted; a null one counts the values), word (counted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        lines: Counter = Counter()

        def counted() -> pa.RecordBatch:
            rows = [{"kind": "word", "word": w, "n": n} for w, n in counts.items()]
            rows += [{"kind": "line", "source": a, "field": b, "line": c, "n": n} for (a, b, c), n in lines.items()]
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for b in batches:
            rows = []
            for i, source, field, text in zip(*(c.to_pylist() for c in b.columns)):
                if not text:
                    continue
                whole, sure, prose, token, line = look(text)
                lines[source, field, None] += 1
                if line:
                    lines[source, field, line] += 1
                if not whole:
                    rows.append({"kind": "end", "id": i, "field": field, "source": source, "sure": sure, "prose": prose, "token": token, "line": line, "chars": len(text), "bytes": len(text.encode())})
                words = WORD.findall((TAG.sub(" ", text) if "<" in text else text).lower())
                counts.update(set(words[:-1]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            if len(counts) + len(lines) > 300_000:
                yield counted()
                counts.clear()
                lines.clear()
        yield counted()

    arrow = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("field", pa.string()), ("source", pa.string()), ("sure", pa.bool_()), ("prose", pa.bool_()), ("token", pa.string()), ("line", pa.string()), ("chars", pa.int32()), ("bytes", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    return values.mapInArrow(run, SCHEMA)


def trie(words: DataFrame, tokens: DataFrame, least: int = 3, depth: int = 64) -> DataFrame:
    """(node, ends, goes_on) of the tokens (node): how often words that ``least`` values or more hold end and go on there.

    The prefixes of up to ``depth`` letters are the nodes of a table; a longer token is looked for among the words that share
    its first ``depth`` letters.
    """
    known = words.where(F.col("n") >= least)
    nodes = known.select(F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(depth)))).alias("k"), "word", "n")
    nodes = nodes.select(F.expr("substring(word, 1, k)").alias("node"), (F.col("k") == F.length("word")).alias("last"), "n")
    nodes = nodes.join(tokens.where(F.length("node") <= depth), "node", "left_semi")
    head = lambda c: F.substring(c, 1, depth)
    long_tokens = tokens.where(F.length("node") > depth).select("node", head("node").alias("head"))
    beyond = known.where(F.length("word") > depth).select("word", "n", head("word").alias("head")).join(long_tokens, "head")
    beyond = beyond.where(F.startswith("word", "node")).select("node", (F.col("word") == F.col("node")).alias("last"), "n")
    ends, goes_on = F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("last"), F.col("n")).otherwise(0))
    return nodes.union(beyond).groupBy("node").agg(ends.alias("ends"), goes_on.alias("goes_on"))


def _spikes(ends: DataFrame, unit: str, least: int) -> DataFrame:
    """Lengths of a field at which ends without a proper end pile up: ``least`` or more, and ten times those nearby on average."""
    by = ends.where("not sure").groupBy("field", F.col(unit).alias("length")).agg(F.count("*").alias("n"))
    near = Window.partitionBy("field").orderBy("length").rangeBetween(-12, 12)  # a row for each length that occurs
    return by.withColumn("near", F.sum("n").over(near)).where((F.col("n") >= least) & (F.col("n") * 24 >= (F.col("near") - F.col("n")) * 10)).select("field", F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}"))


def truncated(df: DataFrame, id_col: str, source_col: str, fields: list[str], spike: int = 8, repeated: int = 4, share: float = 0.01, firm: float = 0.05) -> DataFrame:
    """(id, field, source) of the values of ``fields`` that were cut before their end.

    Null, empty and blank values are whole.  A last line that ``repeated`` or more values of a source and the part
    ``share`` of all its values have is a closing line and no broken sentence, though cut if its word or length shows a cut;
    from the part ``firm`` on only a sign or open markup does.  Ids may be null or repeat; other columns aren't read.  Whole values are read.
    """
    pick = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    values = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), pick.alias("v")).select("id", "source", "v.field", "v.value")
    seen = written(_pass(values.where("value is not null")), "ends")
    ends = seen.where("kind = 'end'")
    words = seen.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = ends.where("token <> ''").select(F.col("token").alias("node")).distinct()
    nodes = trie(words, tokens)
    cut_word = nodes.where("ends = 0 and goes_on > 0").select(F.col("node").alias("token"), F.lit(True).alias("cut_word"))
    lines = seen.where("kind = 'line'").groupBy("source", "field", "line").agg(F.sum("n").alias("same"))
    sizes = lines.where("line is null").select("source", "field", F.col("same").alias("size"))
    lines = lines.where(F.col("line").isNotNull() & (F.col("same") >= repeated))
    closing = lines.join(sizes, lines.source.eqNullSafe(sizes.source) & (lines.field == sizes.field)).select(lines["*"], "size")
    closing = closing.where(F.col("same") >= share * F.col("size")).withColumn("firm", F.col("same") >= firm * F.col("size"))
    # values without a token or a line get keys of their own, which nothing has, so that they don't gather in one task
    alone = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.col(c))
    ends = ends.withColumns({"token": alone("token"), "line": alone("line")})
    out = ends.join(cut_word, "token", "left").join(_spikes(ends, "chars", spike), ["field", "chars"], "left").join(_spikes(ends, "bytes", spike), ["field", "bytes"], "left")
    out = out.join(closing, (out.source.eqNullSafe(closing.source)) & (out.field == closing.field) & (out.line == closing.line), "left").select(out["*"], "firm", "cut_word", "at_chars", "at_bytes")
    shown = F.coalesce("cut_word", "at_chars", "at_bytes", F.lit(False))
    flag = F.col("sure") | (shown & ~F.coalesce("firm", F.lit(False))) | (F.col("prose") & F.col("firm").isNull())
    return out.where(flag).select("id", "field", "source")


def rates(df: DataFrame, id_col: str, source_col: str, fields: list[str]) -> DataFrame:
    """(source, field, n_values, n_cut, cut_share): how often each source truncates; values are those not null or blank."""
    cut = truncated(df, id_col, source_col, fields).groupBy("source", "field").agg(F.count("*").alias("n_cut"))
    pick = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.trim(F.regexp_replace(f, r"\s+", "")) != "").alias("has")) for f in fields]))
    all_ = df.select(F.col(source_col).alias("source"), pick.alias("v")).where("v.has").groupBy("source", "v.field").agg(F.count("*").alias("n_values"))
    joined = all_.join(cut, all_.source.eqNullSafe(cut.source) & (all_.field == cut.field), "left").select(all_["*"], F.coalesce("n_cut", F.lit(0).cast("bigint")).alias("n_cut"))
    return joined.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))
