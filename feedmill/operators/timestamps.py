"""Mixed timestamp texts of feeds, normalised to UTC instants.

Each text yields an array of all its valid interpretations (form, instant, cost).  A Viterbi pass over the records of a source,
in the order of their fetching, picks the cheapest sequence of readings: it pays for changing the form, for going back in
time, for an instant after the fetch, and most for leaving the source's declared order of day and month.

The sequence of a source is never cut and never held in one task: range partitions of (source, time of fetching) are cut into
blocks of bounded length, each block is summed up as the matrix of the cheapest costs from each reading of its first record to
each of its last, the matrices of a source (a few numbers per block) are put together in order, and each block is then solved
between the two readings that were chosen for its ends.  The result is that of one pass over the whole sequence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import groupby
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..schema import iso
from ..scratch import written

#: Records of one source in a block.
BLOCK = 2048
#: What a reading against the declared order of day and month costs; more than all steps to and from it together.
AGAINST = 50.0
EPOCH_START = datetime(1970, 1, 1, tzinfo=timezone.utc)

Reading = tuple[str, datetime | None, float]

# Zone abbreviations in their US or European meaning, hours from UTC.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 1, "bst": 1, "ist": 1, "cet": 1, "cest": 2, "mez": 1, "mesz": 2, "eet": 2, "eest": 3, "msk": 3,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10,
}

# Month names in seven languages, January to December.
_MONTHS = (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "jan feb mar apr may jun jul aug sept oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jänner feber maerz apr mai jun jul aug sep okt nov dez",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "janv févr mars avr mai juin juil aout sept oct nov déc",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ene feb mar abr may jun jul ago set oct nov dic",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "jan fev mar abr mai jun jul ago set out nov dez",
    "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "جانفي فيفري مارس ابريل ماي جوان جويلية اغسطس سبتمبر اكتوبر نوفمبر ديسمبر",
    "ژانویه فوریه مارس آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر",
)
MONTHS = {name: i + 1 for names in _MONTHS for i, name in enumerate(names.split())}

# Units of distances in time, in seconds, and the words around them.
UNITS = {
    **dict.fromkeys("s sec secs second seconds sekunde sekunden seconde secondes segundo segundos ثانية ثوان ثانیه".split(), 1),
    **dict.fromkeys("m min mins minute minutes minuten minuto minutos دقيقة دقائق دقیقه".split(), 60),
    **dict.fromkeys("h hr hrs hour hours stunde stunden heure heures hora horas ساعة ساعات ساعت".split(), 3600),
    **dict.fromkeys("d day days tag tage tagen jour jours día días dia dias يوم أيام يوما روز".split(), 86400),
    **dict.fromkeys("w week weeks woche wochen semaine semaines semana semanas أسبوع أسابيع هفته".split(), 604800),
}
ONE = frozenset("a an one ein eine einer einem un une una um uma".split())
AGO_AFTER, AGO_BEFORE = frozenset("ago atrás پیش".split()), ("vor", "il y a", "hace", "há", "ha", "منذ", "قبل")

_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}
_DROP = dict.fromkeys(map(ord, "​‌‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"))
_ZONE = r"(?P<zone>z|[a-z]{2,4}|(?:utc|gmt)?\s?[+-]\d{1,2}(?::?\d{2})?)?"
_TIME = r"(?P<h>\d{1,2})(?::|h)(?P<mi>\d{2})(?:[:m](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<half>[ap]\.?m\.?)?"
_ISO = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:t|\s|,)\s*{_TIME}\s*(?:uhr)?\s*{_ZONE})?")
_COMPACT = re.compile(r"(?P<y>(?:19|20)\d{2})(?P<mo>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})?(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?)?\s*" + _ZONE)
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:,?\s*(?:at|um|à|a las|às|t)?\s*{_TIME}\s*(?:uhr)?\s*{_ZONE})?")
_TIME_ONLY = re.compile(rf"{_TIME}\s*(?:uhr\b)?\s*{_ZONE}$")
_EPOCH = re.compile(r"(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?")
_NAMED = re.compile(r"(?:(?P<d1>\d{1,2})(?:st|nd|rd|th|er|º|\.)?\s*(?:de\s+)?(?P<m1>[^\W\d_]+)\.?,?\s*(?:de\s+|del\s+)?(?P<y1>\d{4}|\d{2})|(?P<m2>[^\W\d_]+)\.?\s+(?P<d2>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y2>\d{4}))(?P<rest>.*)")
_WEEKDAY = re.compile(r"[^\W\d_]+(?:-feira)?\.?,\s*|(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+")
_JOIN = re.compile(r"^(?:[\s,،]|(?:at|um|à|a las|às|as|on|الساعة|ساعت|و)\s|-\s|t(?=\d))+")


def clean_text(text: str | None) -> str:
    """Lower case, ASCII digits, single spaces, no direction marks; '' for null."""
    return " ".join((text or "").translate(_DROP).translate(_DIGITS).lower().split())


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | timezone:
    try:
        return ZoneInfo(name) if name else timezone.utc
    except (KeyError, ValueError, OSError):
        return timezone.utc


def _offset(zone: str | None):
    """A fixed offset of a zone text; None without one, False for an unknown one."""
    if not zone:
        return None
    z = zone.strip()
    if z in ABBREVIATIONS:
        return timezone(timedelta(hours=ABBREVIATIONS[z]))
    m = re.fullmatch(r"(?:utc|gmt)?\s?([+-])(\d{1,2})(?::?(\d{2}))?", z)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return False
    return timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3] or 0)))


def _instant(y, mo, d, parts: dict, zone_name: str | None) -> datetime | None:
    """The instant of a date and a match's time, or None if there is no such moment.

    A wall-clock time that occurs twice is its first occurrence; a skipped one has the offset before the change: both are
    what fold 0 means.
    """
    h, half = int(parts.get("h") or 0), (parts.get("half") or "").replace(".", "")
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half == "pm" else 0)
    offset = _offset(parts.get("zone"))
    if offset is False:
        return None
    try:
        y = int(y) + (2000 if len(str(y)) == 2 else 0)
        fraction = (parts.get("f") or "").ljust(6, "0")[:6]
        wall = datetime(y, int(mo), int(d), h, int(parts.get("mi") or 0), int(parts.get("s") or 0), int(fraction), tzinfo=offset or _zone(zone_name))
        return wall.astimezone(timezone.utc) if 1970 <= y <= 2199 else None
    except (ValueError, OverflowError):
        return None


def _distance(t: str) -> float | None:
    """Seconds of a text such as '3 hours ago'; None for another text."""
    words = t.split()
    if words and words[-1] in AGO_AFTER:
        words = words[:-1]
    else:
        for lead in AGO_BEFORE:
            if t.startswith(lead + " "):
                words = t[len(lead) :].split()
                break
        else:
            return 0.0 if t in ("just now", "now") else None
    total, k = 0.0, 0
    words = [w.rstrip(",") for w in words if w not in ("and", "und", "et", "y", "e", "about")]
    if len(words) == 1 and (m := re.fullmatch(r"(\d+)([^\W\d_]+)", words[0])):
        words = [m[1], m[2]]
    if len(words) == 1 and words[0] in UNITS:
        words = ["1", *words]
    if not words or len(words) % 2:
        return None
    while k < len(words):
        n, unit = words[k : k + 2]
        if unit not in UNITS or not (n in ONE or re.fullmatch(r"\d{1,6}", n)):
            return None
        total += (1 if n in ONE else int(n)) * UNITS[unit]
        k += 2
    return total


def interpretations(text: str | None, fetched_at: datetime | None, zone_name: str | None, day_first: bool | None) -> list[Reading]:
    """All readings (form, UTC instant, cost) of a text; none for null, empty and unreadable texts and impossible moments.

    fetched_at (with a zone) is needed for distances only; a null zone_name means UTC; with a null day_first both orders of day
    and month cost alike.  Where the declared order names no moment but the other one would, the declared reading stands
    with a null instant: the text is then an impossible date, unless the path pays for leaving the declared order.
    """
    t = clean_text(text)
    out: list[Reading] = []

    def add(form: str, at: datetime | None, cost: float = 0.0) -> None:
        if at is not None:
            late = fetched_at is not None and at > fetched_at + timedelta(days=1)
            out.append((form, at, cost + (3.0 if late else 0.0)))

    if not t or not any(map(str.isdigit, t)) and "ago" not in t and not t.startswith(AGO_BEFORE) and t not in ("now", "just now"):
        return out
    if m := _ISO.fullmatch(t):
        p = m.groupdict()
        add("iso" + p["sep"] + ("t" if p["h"] else ""), _instant(p["y"], p["mo"], p["d"], p, zone_name))
        return out
    if m := _EPOCH.fullmatch(t):
        digits, scale = m[1], {9: 0, 10: 0, 13: 3, 16: 6, 19: 9}[len(m[1])]
        micros = int(digits) * 10 ** (6 - scale) if scale <= 6 else int(digits) // 1000
        if m[2] and scale == 0:
            micros += int(m[2].ljust(6, "0")[:6])
        add(f"epoch{scale}", EPOCH_START + timedelta(microseconds=micros))
    if m := _COMPACT.fullmatch(t):
        p = m.groupdict()
        add("compact", _instant(p["y"], p["mo"], p["d"], p, zone_name), 1.0 if out else 0.0)
    if out:
        return out
    if m := _NUMERIC.fullmatch(t):
        p = m.groupdict()
        readings = {"day": (p["b"], p["a"]), "month": (p["a"], p["b"])}
        if p["a"] == p["b"]:  # both orders name the same day
            readings.pop("month" if day_first in (None, True) else "day")
        for order, (mo, d) in readings.items():
            against = day_first is not None and (order == "day") != day_first and len(readings) > 1
            add(f"{order}{p['sep']}", _instant(p["y"], mo, d, p, zone_name), AGAINST if against else 0.0)
        if len(out) == 1 and out[0][2] >= AGAINST:
            out.insert(0, (("day" if day_first else "month") + p["sep"], None, 0.0))
        return out
    if (seconds := _distance(t)) is not None:
        if fetched_at is not None:
            add("distance", fetched_at - timedelta(seconds=seconds))
        return out
    bare = _WEEKDAY.sub("", t, count=1) if _WEEKDAY.match(t) else t
    if m := _NAMED.fullmatch(bare):
        p = m.groupdict()
        mo = MONTHS.get(p["m1"] or p["m2"])
        rest = _JOIN.sub("", p["rest"] + " ").strip()
        time = _TIME_ONLY.fullmatch(rest) if rest else None
        if mo and (time or not rest):
            parts = time.groupdict() if time else {}
            at = _instant(p["y1"] or p["y2"], mo, p["d1"] or p["d2"], parts, zone_name)
            add("named-day" if p["d1"] else "named-month", at)
    return out


def step(before: Reading, after: Reading) -> float:
    """The cost of ``after`` next to ``before``: a change of form, and a jump back in time by its length."""
    (f, t, _), (g, u, _) = before, after
    back = min(4.0, 2.0 * math.log1p((t - u).total_seconds() / 86400)) if t is not None and u is not None and u < t else 0.0
    return back + (1.0 if f != g else 0.0)


def _forward(records: list[list[Reading]], costs: list[float]) -> tuple[list[float], list[list[int]]]:
    """From the costs of the first record's readings: those of the last one's, and where each reading of the others came from."""
    came, last = [], records[0]
    for options in records[1:]:
        new, origin = [], []
        for o in options:
            ways = [c + step(b, o) for b, c in zip(last, costs)]
            k = min(range(len(ways)), key=ways.__getitem__)
            new.append(ways[k] + o[2])
            origin.append(k)
        came.append(origin)
        costs, last = new, options
    return costs, came


def cheapest(records: list[list[Reading]]) -> list[int | None]:
    """For each record of a sequence the number of the reading on the cheapest path; None for one without readings."""
    live = [(i, r) for i, r in enumerate(records) if r]
    picks: list[int | None] = [None] * len(records)
    if live:
        costs, came = _forward([r for _, r in live], [o[2] for o in live[0][1]])
        k = min(range(len(costs)), key=costs.__getitem__)
        for (i, _), origin in zip(reversed(live), [*reversed(came), None]):
            picks[i] = k
            k = origin[k] if origin else k
    return picks


def matrix(records: list[list[Reading]]) -> list[list[float]]:
    """The cheapest costs from each reading of the first record to each of the last; each record must have one."""
    if all(len(r) == 1 for r in records):  # nothing to choose
        return [[sum(r[0][2] for r in records) + sum(step(a[0], b[0]) for a, b in zip(records, records[1:]))]]
    start = range(len(records[0]))
    return [_forward(records, [records[0][i][2] if i == j else math.inf for j in start])[0] for i in start]


def joined(blocks: list[tuple[list[Reading], list[Reading], list[list[float]]]]) -> list[tuple[int, int]]:
    """For each block (readings of its first record, of its last, matrix) of a sequence the two readings on the cheapest path."""
    came, costs, last = [], [0.0], None
    for first, end, m in blocks:
        enter = []
        for o in first:
            ways = [c + (step(b, o) if last else 0.0) for b, c in zip(last or [None], costs)]
            k = min(range(len(ways)), key=ways.__getitem__)
            enter.append((ways[k], k))
        new, origin = [], []
        for j in range(len(end)):
            i = min(range(len(first)), key=lambda i: enter[i][0] + m[i][j])  # noqa: B023
            new.append(enter[i][0] + m[i][j])
            origin.append((i, enter[i][1]))
        came.append(origin)
        costs, last = new, end
    out = []
    k = min(range(len(costs)), key=costs.__getitem__)
    for origin in reversed(came):
        i, before = origin[k]
        out.append((i, k))
        k = before
    return out[::-1]


def _micros(at: datetime | None) -> int | None:
    return None if at is None else (at - EPOCH_START) // timedelta(microseconds=1)


def _moment(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH_START + timedelta(microseconds=micros)


def _packed(options: list[Reading]) -> list[dict]:
    return [{"form": f, "at": _micros(a), "cost": c} for f, a, c in options]


def _unpacked(options: list[dict]) -> list[Reading]:
    return [(o["form"], _moment(o["at"]), o["cost"]) for o in options]


_END = pa.list_(pa.struct([("form", pa.string()), ("at", pa.int64()), ("cost", pa.float64())]))


def _blocks(rows: DataFrame, kinds: dict[str, str], size: int) -> DataFrame:
    """One row for each block: its place (part, no), its source, its matrix between the ends, and its records' readings."""
    schema = (
        f"part int, no int, source_id {kinds['source_id']}, first array<struct<form:string,at:bigint,cost:double>>, "
        "last array<struct<form:string,at:bigint,cost:double>>, costs array<double>, "
        f"entries array<{kinds['entry_id']}>, counts array<int>, forms array<string>, moments array<bigint>, extra array<double>"
    )
    columns = ("entry_id", "source_id", "published_at", "fetched_at", "zone_name", "day_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, source, key_type = TaskContext.get().partitionId(), 0, [], None, pa.int64()

        def block() -> pa.RecordBatch:
            records = [r for _, r in held]
            flat = [o for r in records for o in r]
            row = [
                part, no, source, _packed(records[0]), _packed(records[-1]), [c for line in matrix(records) for c in line], [e for e, _ in held],
                [len(r) for r in records], [o[0] for o in flat], [_micros(o[1]) for o in flat], [o[2] for o in flat],
            ]
            types = [
                pa.int32(), pa.int32(), source_type, _END, _END, pa.list_(pa.float64()), pa.list_(key_type),
                pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()),
            ]
            names = ["part", "no", "source_id", "first", "last", "costs", "entries", "counts", "forms", "moments", "extra"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            key_type, source_type = b.schema.field("entry_id").type, b.schema.field("source_id").type
            for e, s, text, at, zone, first in zip(*(b.column(c).to_pylist() for c in columns)):
                if held and (s != source or len(held) >= size):
                    yield block()
                    no, held = no + 1, []
                if at is not None and at.tzinfo is None:
                    at = at.replace(tzinfo=timezone.utc)
                found = interpretations(text, at, zone, first)
                if found:
                    source = s
                    held.append((e, found))
        if held:
            yield block()

    return rows.mapInArrow(run, schema)


def _chosen(blocks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(part, no, i, j): the readings on the cheapest path at the ends of each block.  A source's row here is its blocks' matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: r["source_id"]):
            places, ends = [], []
            for r in group:
                places.append((r["part"], r["no"]))
                n = len(r["last"])
                lines = [r["costs"][k : k + n] for k in range(0, len(r["costs"]), n)]
                ends.append((_unpacked(r["first"]), _unpacked(r["last"]), lines))
            picks = joined(ends)
            columns = [[p for p, _ in places], [n for _, n in places], [i for i, _ in picks], [j for _, j in picks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["part", "no", "i", "j"])

    ends = blocks.select("part", "no", "source_id", "first", "last", "costs").repartition("source_id").sortWithinPartitions("source_id", "part", "no")
    return ends.mapInArrow(run, "part int, no int, i int, j int")


def _solved(blocks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    columns = ("source_id", "entries", "counts", "forms", "moments", "extra", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key_type, source_type = b.schema.field("entries").type.value_type, b.schema.field("source_id").type
            for source, entries, counts, forms, moments, extra, i, j in zip(*(b.column(c).to_pylist() for c in columns)):
                if len(forms) == len(entries):  # one reading each
                    at = list(range(len(forms)))
                else:
                    starts = [0]
                    for n in counts:
                        starts.append(starts[-1] + n)
                    records = [[(forms[k], _moment(moments[k]), extra[k]) for k in range(x, y)] for x, y in zip(starts, starts[1:])]
                    ends = {0: i, len(records) - 1: j}
                    records = [[r[ends[k]]] if k in ends else r for k, r in enumerate(records)]
                    at = [starts[k] + ends.get(k, pick) for k, pick in enumerate(cheapest(records))]
                keep = [k for k, x in enumerate(at) if moments[x] is not None]
                found = [
                    pa.array([entries[k] for k in keep], key_type), pa.array([source] * len(keep), source_type), pa.array([moments[at[k]] for k in keep], pa.int64()),
                    pa.array([forms[at[k]] for k in keep], pa.string()), pa.array([counts[k] for k in keep], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(found, names=["entry_id", "source_id", "micros", "form", "n_readings"])

    schema = f"entry_id {kinds['entry_id']}, source_id {kinds['source_id']}, micros bigint, form string, n_readings int"
    return blocks.mapInArrow(run, schema)


def normalise(entries: DataFrame, zones: DataFrame | None, block: int = BLOCK, day_first: bool | None = None) -> DataFrame:
    """(entry_id, source_id, published_utc, form, n_readings, micros): one row for each entry with a readable published_at.

    entries: entry_id, source_id, fetched_at, published_at (text); zones: source_id, zone_name, day_first, one row per source (a
    small control table).  published_utc has milliseconds, cut and not rounded; micros is the instant itself.  A source that isn't
    in zones is read as UTC; its order of day and month is ``day_first``, and where that is null too its records decide.  Ids may be null or repeat; entries of a
    null source form a source of their own; other columns aren't read.  An empty table gives an empty one.
    """
    if zones is None:
        zones = entries.sparkSession.createDataFrame([], f"source_id {dict(entries.dtypes)['source_id']}, zone_name string, day_first boolean")
    control = zones.groupBy("source_id").agg(F.min("zone_name").alias("zone_name"), F.min("day_first").alias("day_first"))
    rows = entries.where(F.col("published_at").isNotNull())
    rows = rows.select("entry_id", "source_id", "published_at", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = rows.join(control, "source_id", "left")
    if day_first is not None:
        rows = rows.withColumn("day_first", F.coalesce("day_first", F.lit(day_first)))
    order = ["source_id", "fetched_at", "entry_id", "published_at"]
    kinds = dict(rows.dtypes)
    blocks = written(_blocks(rows.repartitionByRange(*order).sortWithinPartitions(*order), kinds, block), "time-blocks")
    found = _solved(blocks.drop("first", "last", "costs").join(_chosen(blocks, kinds), ["part", "no"]), kinds)
    return found.select("entry_id", "source_id", iso(F.timestamp_micros("micros")).alias("published_utc"), "form", "n_readings", "micros")
