"""Properties over generated inputs."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.operators.live import pad_literal
from strandlog.sources import vlog

ASCII = st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=20)


@given(st.integers(-(2**63), 2**63 - 1))
def test_zigzag_roundtrip(n):
    raw = vlog.zigzag(n)
    assert vlog.unzigzag(raw) == n and len(raw) <= 10


@given(ASCII)
def test_padding_is_idempotent_and_has_one_width(key):
    assert len(pad_literal(key)) == 10 and pad_literal(pad_literal(key)) == pad_literal(key)


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 5), ASCII, st.text(max_size=30)), max_size=8), st.booleans())
@settings(deadline=None)
def test_log_bytes_roundtrip(tmp_path_factory, rows, demo):
    path = tmp_path_factory.mktemp("log") / "x.vlog"
    rows = [(i, t, v, k, "".join(c for c in x if not "\ud800" <= c <= "\udfff")) for i, t, v, k, x in rows]
    path.write_bytes(b"".join(vlog.pack(i, t, v, k, x, demo) for i, t, v, k, x in rows))
    got = [tuple(r.values())[1:] for b in vlog.records(str(path), demo, 0, path.stat().st_size, False) for r in b.to_pylist()]
    names = ["idx", "term", "voted_for", "key", "value"]
    if rows:
        batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))
        data, ends = vlog.encoded(batch, demo)
        assert data.to_pybytes() == path.read_bytes() and ends.tolist() == [*[r[0] for r in got][1:], path.stat().st_size]
    assert [(r[6], r[7]) for r in got] == [(pad_literal(k), x) for *_, k, x in rows]
    if not demo:
        assert [r[1:4] for r in got] == [x[:3] for x in rows]
    assert [r[0] for r in got] == [sum((8 if demo else 20) + 10 + len(x[4].encode()) for x in rows[:n]) for n in range(len(rows))]
