import random
from datetime import datetime, timezone

import pytest

from feedmill.operators import timestamps as T

AT = datetime(2026, 5, 10, 12, 30, 15, 500000, tzinfo=timezone.utc)
CASES = [
    ("1705073504", "UTC", True, "2024-01-12T15:31:44.000Z"), ("1715064116077", "UTC", True, "2024-05-07T06:41:56.077Z"), ("Tue, 28 May 2024 03:07:26 +0200", "UTC", True, "2024-05-28T01:07:26.000Z"),
    ("2024-03-07T14:12:33+05:30", "UTC", True, "2024-03-07T08:42:33.000Z"), ("2025-01-16T05:33:01+00", "UTC", True, "2025-01-16T05:33:01.000Z"), ("Tue, 19 Mar 2024 05:20:36 PDT", "UTC", True, "2024-03-19T12:20:36.000Z"),
    ("2024-03-07T14:12:33.479999+05:30", "UTC", True, "2024-03-07T08:42:33.479Z"), ("٢٠٢٤/٠٤/٠١ ١٥:٢٦", "Asia/Riyadh", True, "2024-04-01T12:26:00.000Z"), ("٣١ يناير ٢٠٢٤ ١١:٥٣", "Asia/Dubai", True, "2024-01-31T07:53:00.000Z"),
    ("2024-10-21T08:02:37", "Europe/Berlin", True, "2024-10-21T06:02:37.000Z"), ("02.12.2024, 22:18 Uhr", "Europe/Berlin", True, "2024-12-02T21:18:00.000Z"), ("04/12/2024 17:11", "Europe/London", True, "2024-12-04T17:11:00.000Z"),
    ("04/12/2024 17:11", "America/New_York", False, "2024-04-12T21:11:00.000Z"), ("February 24, 2026 at 7:06 AM", "America/Los_Angeles", False, "2026-02-24T15:06:00.000Z"), ("1/28/2025 7:32 PM", "America/New_York", False, "2025-01-29T00:32:00.000Z"),
    ("2024-03-15", "Europe/Madrid", True, "2024-03-14T23:00:00.000Z"), ("20250929T223830", "UTC", True, "2025-09-29T22:38:30.000Z"), ("7 hours ago", "UTC", True, "2026-05-10T05:30:15.500Z"), ("an hour ago", "UTC", True, "2026-05-10T11:30:15.500Z"),
    ("3 days ago", "UTC", True, "2026-05-07T12:30:15.500Z"), ("31 mai 2025 à 1h38", "Europe/Paris", True, "2025-05-30T23:38:00.000Z"), ("13. Januar 2024 13:56", "Europe/Berlin", True, "2024-01-13T12:56:00.000Z"),
    ("Jun 16, 2025", "UTC", False, "2025-06-16T00:00:00.000Z"), ("16 July 2025", "UTC", True, "2025-07-16T00:00:00.000Z"), ("\xa0Wed, 15 Apr 2026 18:31:19 +0100", "UTC", True, "2026-04-15T17:31:19.000Z"),
    ("14 de abril de 2025, 10:30", "America/Sao_Paulo", True, "2025-04-14T13:30:00.000Z"), ("2025-08-19 03:50:45 UTC", "Asia/Tehran", True, "2025-08-19T03:50:45.000Z"), ("12/05/2024 12:05 AM", "UTC", False, "2024-12-05T00:05:00.000Z"),
    # twice: the first; skipped: the offset before the change
    ("2024-10-27T02:30:00", "Europe/Berlin", True, "2024-10-27T00:30:00.000Z"), ("26 mars 2023 à 2h15", "Europe/Paris", True, "2023-03-26T01:15:00.000Z"), ("November 2, 2025 at 1:25 AM", "America/Los_Angeles", False, "2025-11-02T08:25:00.000Z"),
]
NOTHING = ["soon", "Spring", "", " ", "—", "n/a", None, "24:61", "0000-00-00", "2025-13-04 08:00", "31/04/2025 12:00", "2025-02-30T10:00:00Z", "Invalid Date", "null", "13:61 PM", "May", "99", "2024-05-05T10:00:00 XYZ", "5 bananas ago"]


@pytest.mark.parametrize("text, zone, day_first, want", CASES)
def test_readings(text, zone, day_first, want):
    found = T.interpretations(text, AT, zone, day_first)
    found = [found[k] for k in T.cheapest([found])]  # the reading against the declared order is there, and costs most
    assert [f"{a:%Y-%m-%dT%H:%M:%S}.{a.microsecond // 1000:03d}Z" for _, a, _ in found] == [want]


@pytest.mark.parametrize("text", NOTHING)
def test_no_reading(text):
    assert T.interpretations(text, AT, "UTC", True) == []


def test_viterbi_settles_day_and_month():
    texts = ["03/05/2026 10:00", "04/05/2026 10:00", "13/05/2026 09:00", "14/05/2026 09:00", "06/05/2026 10:00"]
    at = datetime(2026, 5, 15, tzinfo=timezone.utc)
    records = [T.interpretations(t, at, "UTC", None) for t in texts]
    assert [len(r) for r in records] == [2, 2, 1, 1, 2]
    picks = T.cheapest(records)
    assert [r[k][1].month for r, k in zip(records, picks)] == [5, 5, 5, 5, 5]
    assert T.cheapest([]) == [] and T.cheapest([[], records[2], []]) == [None, 0, None]


def test_cutting_at_certain_records_changes_nothing():
    import itertools
    import random

    rng = random.Random(3)
    day = lambda d: datetime(2026, 1, 1 + d, tzinfo=timezone.utc)
    for _ in range(60):
        records = [[(rng.choice("ab"), day(rng.randrange(20)), float(rng.randrange(3))) for _ in range(rng.choice([1, 2, 3]))] for _ in range(5)]

        def cost(path):
            total, last = 0.0, None
            for r, k in zip(records, path):
                f, a, c = r[k]
                total += c
                if last:
                    total += (1.0 if f != last[0] else 0.0) + (min(4.0, 2.0 * T.math.log1p((last[1] - a).total_seconds() / 86400)) if a < last[1] else 0.0)
                last = (f, a)
            return total

        best = min(map(cost, itertools.product(*[range(len(r)) for r in records])))
        assert cost(T.cheapest(records)) == pytest.approx(best)


def test_the_declared_order_is_a_cost_and_not_a_filter():
    both = T.interpretations("04/12/2024 17:11", AT, "UTC", True)
    assert [(r[0], r[1].month, r[2]) for r in both] == [("day/", 12, 0.0), ("month/", 4, T.AGAINST)]
    only = T.interpretations("04/25/2024", AT, "UTC", True)
    assert only[0][1] is None and only[1][1].month == 4 and T.cheapest([only]) == [0]
    assert len(T.interpretations("04/04/2024", AT, "UTC", False)) == 1


def test_blocks_give_the_path_of_the_whole_sequence():
    rng = random.Random(5)
    day = lambda d: datetime(2026, 1, 1 + d, tzinfo=timezone.utc)

    def total(records, picks):
        chosen = [r[k] for r, k in zip(records, picks)]
        return sum(o[2] for o in chosen) + sum(T.step(a, b) for a, b in zip(chosen, chosen[1:]))

    for _ in range(80):
        some = lambda: day(rng.randrange(20)) if rng.random() < 0.9 else None
        records = [[(rng.choice("abc"), some(), rng.random()) for _ in range(rng.choice([1, 2, 3]))] for _ in range(rng.randrange(1, 12))]
        n = rng.choice([1, 2, 3, 5])
        cut = [records[k : k + n] for k in range(0, len(records), n)]
        ends = T.joined([(b[0], b[-1], T.matrix(b)) for b in cut])
        picks = []
        for b, (i, j) in zip(cut, ends):
            fixed = [[o for k, o in enumerate(r) if (x or k == i) and (x < len(b) - 1 or k == j)] for x, r in enumerate(b)]
            inner = T.cheapest(fixed)
            picks += [i if x == 0 else j if x == len(b) - 1 else k for x, k in enumerate(inner)]
        assert total(records, picks) == pytest.approx(total(records, T.cheapest(records)))


def test_normalise_over_block_limits(spark):
    rows = [(k, k % 2, datetime(2026, 5, 1 + k // 40, k % 24, k % 60, tzinfo=timezone.utc), f"{1 + k % 12:02d}/05/2026 10:00") for k in range(200)]
    raw = spark.createDataFrame(rows, "entry_id bigint, source_id int, fetched_at timestamp, published_at string")
    zones = spark.createDataFrame([(0, "UTC", None)], "source_id int, zone_name string, day_first boolean")
    want = {(r.entry_id, r.published_utc) for r in T.normalise(raw, zones).collect()}
    assert len(want) == 200
    assert {(r.entry_id, r.published_utc) for r in T.normalise(raw, zones, block=7).collect()} == want


def test_normalise(spark):
    rows = [(1, 7, AT, "2026-05-01", "x"), (2, 7, AT, "soon", "x"), (3, 8, AT, "05/06/2026 10:00", "x"), (4, 9, None, "2 hours ago", "x"), (5, None, AT, "2026-05-01T00:00:00", "x"), (None, 7, AT, "1705073504", "x"), (1, 7, AT, "2026-05-01", "x"), (6, 7, AT, None, "x")]
    raw = spark.createDataFrame(rows, "entry_id bigint, source_id int, fetched_at timestamp, published_at string, zone_name string")
    zones = spark.createDataFrame([(7, "Europe/Berlin", True), (8, "America/New_York", False), (8, "America/New_York", False)], "source_id int, zone_name string, day_first boolean")
    got = sorted((str(r.entry_id), r.published_utc) for r in T.normalise(raw, zones).collect())
    assert got == [("1", "2026-04-30T22:00:00.000Z"), ("1", "2026-04-30T22:00:00.000Z"), ("3", "2026-05-06T14:00:00.000Z"), ("5", "2026-05-01T00:00:00.000Z"), ("None", "2024-01-12T15:31:44.000Z")]
    assert T.normalise(raw.limit(0), zones).count() == 0 and T.normalise(raw, zones.limit(0)).count() == 5
