import json
import os
import random
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.sources import json_array as J

NASTY = ["", "plain", 'q"uote', "back\\", 'both\\"', "{", "}", "[{", "]}", '"jobs":[', "é日本", "\n\t", "\\\\", "a}b{c", '","', "}" * 5]


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return rng.choice(NASTY)
    if kind == 3:
        return rng.choice([None, 1, -2.5, True])
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice([*NASTY, "jobs"]): _value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return {"jobs": [_value(rng, depth + 1)]}


def _record(rng):
    return {"id": rng.randrange(1000), "x": _value(rng), rng.choice(NASTY): _value(rng)}


def _ranges(raw, cuts):
    """What the text reader gives the tasks: the fragments that begin in each range, closing brackets put back."""
    pieces = raw.split(b"}")
    if not pieces[-1]:
        pieces.pop()
    starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])[:len(pieces)]
    edges = [-1, *sorted(set(cuts)), len(raw)]  # a line that begins at a range's first byte is read by the range before it
    out = [(a, b"".join(p + b"}" for p, s in zip(pieces, starts, strict=True) if a < s <= b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [(a, t) for a, t in out if t]


def _read(raw, cuts, chunk):
    key = J._key_pattern("jobs")
    ranges, rows = _ranges(raw, cuts), []
    parts = {a: _chunks(t, chunk) for a, t in ranges}
    for a, chunks in parts.items():
        for state in (False, True):
            s = J._Summary(state)
            for c in chunks:
                s.add(c, key)
            rows.append({"file": "f", "block": a, "state": state, "inside": s.inside, "closes": s.closes, "opens": s.opens, "least": s.least, "first": s.first})
    begins, depth = J._begins(rows)
    got, waiting = [], b""
    for a, chunks in parts.items():
        cutter = J._Cutter(*begins["f", a], depth["f"])
        for c in chunks:
            for kind, text in cutter.add(c, key):
                got.append(json.loads(waiting + text if kind == "h" else text))
                waiting = b"" if kind == "h" else waiting
        if cutter.open:
            waiting = (waiting if cutter.kind == "h" else b"") + b"".join(cutter.part)
    return got


def _chunks(text, n):
    """Arrow batches: cut behind closing brackets."""
    ends = [i + 1 for i, c in enumerate(text) if c == 125][n - 1::n]
    cuts = [0, *[e for e in ends if e < len(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 12), st.integers(1, 5), st.sampled_from(["array", "envelope", "single", "lines"]), st.sampled_from([None, 1]))
def test_records_of_any_ranges_are_those_of_json(seed, n_cuts, chunk, kind, indent):
    rng = random.Random(seed)
    records = [_record(rng) for _ in range(rng.randrange(8))]
    if kind == "array":
        raw = json.dumps(records, indent=indent, ensure_ascii=rng.random() < 0.5)
    elif kind == "envelope":
        around = [("a", _value(rng, 1)), ("other", [{"no": 1}]), ("meta", {"jobs": [{"inner": 1}]}), ("jobs", records)]
        rng.shuffle(around)
        raw = json.dumps(dict(around), indent=indent)
    elif kind == "single":
        records = [{"id": 1, "x": _value(rng), "jobs": None}]
        raw = json.dumps(records[0], indent=indent)
    else:
        raw = "\n".join(json.dumps(r) for r in records) + "\n"
        if any('"jobs": [' in line for line in raw.split("\n")):  # (top objects with a jobs array are envelopes)
            return
    raw = raw.encode()
    cuts = [rng.randrange(1, len(raw) + 1) for _ in range(n_cuts)]
    assert _read(raw, cuts, chunk) == records


def test_brackets_know_strings():
    raw = np.frombuffer(rb'{"a\"}": "\\", "b": [1, "]"]}', np.uint8)
    at, inside = J.brackets(raw, False)
    assert bytes(raw[at]) == b"{[]}" and not inside
    at, inside = J.brackets(np.frombuffer(b'x}", {"', np.uint8), True)
    assert len(at) == 1 and inside


@pytest.mark.parametrize("kind", ["array", "envelope"])
def test_one_file_is_read_by_several_tasks(spark, kind):
    rng = random.Random(3)
    records = [dict(_record(rng), id=i, long="x}" * rng.choice([1, 1, 3000])) for i in range(800)]
    path = os.path.join(tempfile.mkdtemp(prefix="pl-json-"), "jobs.json")
    with open(path, "w") as f:
        json.dump(records if kind == "array" else {"at": "{", "jobs": records, "more": [{"id": -1}]}, f)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = J.json_records(spark, path)
        assert got.rdd.getNumPartitions() > 8
        rows = got.orderBy("block", "seq").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [json.loads(r.text) for r in rows] == records
    assert len({r.block for r in rows}) > 8


def test_empty_files(spark):
    base = tempfile.mkdtemp(prefix="pl-json-")
    for name, text in (("a.json", "[]"), ("b.json", ""), ("c.json", '{"jobs": []}'), ("d.json", '[1, "x", {"id": 1}]')):
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    assert [r.text for r in J.json_records(spark, base).collect()] == ['{"id": 1}']
