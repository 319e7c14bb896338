"""Properties of the pure functions under the operators."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import mixing, quality, simhash, spans, substrings, suffixes

PAIRS = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)


@given(PAIRS)
def test_merged_spans_cover_the_same_bytes(pairs):
    got = spans.merged(pairs)
    cover = lambda runs: {i for a, b in runs for i in range(a, b)}
    assert cover(got) == cover(pairs) and all(x[1] < y[0] for x, y in zip(got, got[1:]))


@given(st.binary(max_size=90), PAIRS)
def test_cutting_keeps_the_rest(raw, pairs):
    runs = spans.merged([(min(a, len(raw)), min(b, len(raw))) for a, b in pairs])
    gone = {i for a, b in runs for i in range(a, b)}
    assert spans.cut(raw, runs) == bytes(x for i, x in enumerate(raw) if i not in gone)


@given(st.binary(max_size=3000))
def test_chunks_partition_a_text(raw):
    ends = substrings.chunk_ends(raw)
    assert ends == sorted(set(ends)) and (ends[-1] == len(raw) if raw else ends == [])
    assert all(y - x <= substrings.MOST for x, y in zip([0, *ends], ends))


@settings(max_examples=200)
@given(st.text(alphabet="abé ", max_size=80), st.integers(1, 30))
def test_suffixes_are_sorted(text, depth):
    raw = text.encode()
    got = suffixes.two_stage_suffix_array(raw, depth).tolist()
    keys = [raw[i : i + depth] for i in got]
    assert sorted(got) == list(range(len(raw))) and keys == sorted(keys)


@settings(max_examples=200)
@given(st.text(alphabet="ab", max_size=120))
def test_pieces_hold_each_window_once(text):
    raw = text.encode()
    found = suffixes.pieces_of(raw, 20, 16, 4)
    starts = [i for _, _, a, n, _ in found for i in range(a, a + n)]
    assert starts == list(range(max(0, len(raw) - 15)))
    bucket = {}
    for key, _, a, n, end in found:
        assert end == min(a + n + 19, len(raw))
        for i in range(a, a + n):
            assert bucket.setdefault(raw[i : i + 16], key) == key


@given(st.text(alphabet="ab \n#A", max_size=120))
def test_measurements_are_bounded(text):
    m = dict(zip(quality.MEASUREMENTS, quality.measure(text)))
    assert 0 <= m["n_repeat_words"] <= m["n_words"] <= m["word_chars"] <= len(text) and m["n_dup_lines"] <= max(0, m["n_lines"] - 1)


@given(st.text(max_size=60), st.integers(1, 5))
def test_fingerprints_ignore_ascii_case_and_space(text, k):
    other = " \n".join("".join(c.upper() if "a" <= c <= "z" else c for c in text).split(" "))
    assert simhash.simhash(text, k) == simhash.simhash(other, k)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.floats(0, 2))
def test_targets_share_the_budget(sizes, budget):
    total = budget * sum(sizes)
    got = mixing.water_fill(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))], total, 2)
    assert abs(sum(got) - total) < 1e-6 * (1 + total) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
