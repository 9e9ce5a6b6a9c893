"""Properties of the kernels, on generated input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import bpe, decontaminate, jaccard, media, queries, substring_dedup, suffix_dedup, warc

TEXT = st.text(alphabet="abst \n\té'1!中　\U0001F600", max_size=80)
FEW = settings(max_examples=60, deadline=None)


@FEW
@given(TEXT, st.integers(1, 79))
def test_a_cut_at_a_boundary_changes_no_ids(text, at):
    ranks, pattern = queries.tokenizer()
    encode = bpe._encoding(ranks, pattern).encode_ordinary
    for b in bpe.boundaries(text, pattern):
        assert encode(text[:b]) + encode(text[b:]) == encode(text)


@FEW
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=9), min_size=1, max_size=4))
def test_search_finds_every_occurrence(words, items):
    doc = b" ".join(words).decode()
    rows = [(str(i), b" ".join(x)) for i, x in enumerate(items)]
    runs, names = decontaminate.SearchTables(rows, 3).mark(words)
    want = decontaminate.brute_force([(1, doc)], [(i, x.decode()) for i, x in rows], 3)[0]
    assert (sum(b - a for a, b in runs), len(names)) == (want[2], want[3])


@FEW
@given(st.binary(min_size=50, max_size=200).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_stretches_cover_each_start_once(text):
    begin, last, seed, rank, left, right = suffix_dedup.stretches(text)
    assert begin[0] == 0 and last[-1] == len(text) - 50 and (begin[1:] == last[:-1] + 1).all() and (last - begin < 50).all()
    whole = {}
    for b, e, r in zip(begin, last, rank):
        assert whole.setdefault(int(r), text[b : e + 50]) == text[b : e + 50]


@FEW
@given(st.lists(st.integers(0, 5), min_size=50, max_size=120), st.integers(0, 40))
def test_equal_windows_share_an_anchor(values, shift):
    names = np.array(values, np.uint64) * np.uint64(977) + np.uint64(1)
    other = np.r_[np.arange(shift, dtype=np.uint64) + np.uint64(10_000), names]
    shared = np.intersect1d(substring_dedup.anchors(names)[1], substring_dedup.anchors(other)[1])
    assert len(substring_dedup.candidates(names, shared)) == len(names) - 49


@FEW
@given(st.sets(st.integers(0, 60), min_size=4, max_size=40), st.sets(st.integers(0, 60), max_size=4), st.sampled_from([(90, 100), (8, 10)]))
def test_linked_sets_share_what_is_required(a, b, threshold):
    num, den = threshold
    other = (a - set(sorted(a)[: len(b) // 2])) | b
    if den * len(a & other) >= num * len(a | other):
        assert len(a & other) >= max(jaccard.required(len(a), num, den), jaccard.required(len(other), num, den))


@FEW
@given(st.binary(max_size=300))
def test_media_round_trip(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and payload.startswith(text) and media.from_wav(media.to_wav(payload)) == payload
    assert media.find_media(media.to_wav(payload))[0] == ("audio/wav", 0, len(payload) + 44)


@FEW
@given(st.lists(st.binary(max_size=60), max_size=12))
def test_archive_round_trip(payloads):
    records = [warc.build_record(i, "http://x", p, None, "response") for i, p in enumerate(payloads)]
    assert [warc.parse_record(r)["payload"] for r in warc.read_archive(warc.build_archive(records))] == payloads
