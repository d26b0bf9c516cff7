"""The stream of alerts against a simulation of each client by itself, and its parts."""

import datetime as dt
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd

from quire.llm import followup as f

START = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, bucket int, t_us string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, n int, batch string"


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def simulated(clicks, sales):
    """(batch, client, opened, due, n), from the definition."""
    events = [(0, c[0], c[1], c[2], c[3]) for c in set(clicks) if c[4] == "error"] + [(1, s[0], s[2], s[3], s[1]) for s in sales]
    rows = []
    for kind, id_, t, arrived, client in events:
        if client is None or t is None:
            continue
        hours = ((arrived or START) - START) // H + 80 * (zlib.crc32(str(id_ or 0).encode()) % 4)
        rows.append((max(0, min(7, hours * 8 // 3648)), client, us(t), kind))
    marks = [max((t for b, _, t, _ in rows if b < k), default=None) for k in range(8)]
    marks = [None if m is None else m - 96 * 3600 * 10**6 for m in marks]
    out, day = [], 24 * 3600 * 10**6
    late = [r for r in rows if marks[r[0]] is not None and r[2] < marks[r[0]]]
    out += [(b, c, -1, -1, n) for (b, c), n in Counter((r[0], r[1]) for r in late).items()]
    own = defaultdict(list)
    for r in rows:
        if marks[r[0]] is None or r[2] >= marks[r[0]]:
            own[r[1]].append((r[2], r[3]))
    for client, es in own.items():
        open_ = None
        alerts = []
        for t, kind in [*sorted(es), (10**18, 1)]:
            if open_ and t > open_[1]:
                alerts.append(open_)
                open_ = None
            if kind == 1:
                open_ = None
            elif open_:
                open_ = (open_[0], t + day, open_[2] + 1)
            else:
                open_ = (t, t + day, 1)
        out += [(next((b for b in range(8) if marks[b] is not None and marks[b] > due), 8), client, opened, due, n) for opened, due, n in alerts]
    return sorted(out)


def found(spark, clicks, sales):
    made = f.missing_follow_ups(spark.createDataFrame([(*c, 1, "x") for c in clicks], CLICKS), spark.createDataFrame([(*s, 1, "x") for s in sales], SALES), buckets=4)
    return sorted(tuple(r) for r in made.collect())


def test_stream_equals_simulation(spark):
    r = random.Random(4)
    at = lambda: START + r.randint(0, 2600) * H + dt.timedelta(microseconds=r.choice([0, 0, 1, 7]))
    clicks, sales = [], []
    for k in range(1500):
        t, client = at(), r.choice([1, 1, 1, 2, 3, 4, *range(5, 60), None])
        clicks.append((k, r.choice([t, t, t, t, None]) if k % 50 == 0 else t, t + r.choice([0, 0, 0, 30, 300]) * H, client, r.choice(["error", "error", "view", None])))
    for k in range(1200):
        t = at()
        sales.append((k, r.choice([1, 1, *range(2, 60), None]), t, t + r.choice([0, 0, 5, 200]) * H))
    clicks += [(None, START, None, 90, "error"), (5000, dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 1), 91, "error")]
    t = START + 500 * H
    clicks += [(6000, t, t, 95, "error"), (6001, t, t, 95, "error"), (6001, t, t, 95, "error"), (6002, t, t, 96, "error"), (6003, t, t, 97, "error")]
    sales += [(7000, 95, t, t), (7001, 96, t + 24 * H, t), (7002, 97, t + 24 * H + dt.timedelta(microseconds=1), t), (None, 98, t, None)]
    clicks += clicks[:40]
    want = simulated(clicks, sales)
    assert found(spark, clicks, sales) == want
    assert {b for b, *_ in want} >= {1, 3, 5, 8} and any(x[2] == -1 for x in want)
    assert not any(c in (95, 96) for _, c, *_ in want) and any(c == 97 for _, c, *_ in want)


def test_no_events(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, START, START, None, "error"), (2, None, START, 1, "error"), (3, START, START, 1, "view")], []) == []


def test_condensing_any_part_changes_nothing():
    r = random.Random(9)
    for _ in range(150):
        rows = [(0, 1, 50 * f.HOUR_US, r.choice([f.CLICK, f.SALE]), r.choice([1, 2]), r.randint(45, 120) * f.HOUR_US, 1) for _ in range(r.randint(1, 40))]
        columns = [c.split()[0] for c in f.ROW.split(", ")]
        plain = pd.DataFrame(rows, columns=columns)
        cut = r.randint(0, len(rows))
        parts = [f.condensed(x) for x in (plain[:cut], plain[cut:]) if len(x)]
        small = pd.concat(parts)
        late = small[small["kind"] == f.LATE].groupby("client_id")["n"].sum().to_dict()
        assert late == plain[plain["t_us"] < plain["w_us"]].groupby("client_id").size().to_dict()

        def alerts(x):
            x = x[(x["kind"] <= f.SALE) & (x["t_us"] >= x["w_us"])]
            heap = sorted(zip(x["t_us"], x["kind"], x["client_id"], x["n"], strict=True))
            return sorted(f.advance({}, heap, f.ALWAYS))

        assert alerts(small) == alerts(plain)
        sales = small[small["kind"] == f.SALE]
        assert len(sales) <= len(parts) * 2 * 2 * 7
