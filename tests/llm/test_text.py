import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievepath.llm import _text as tx


def plain_runs(s):
    f = tx._folded(s)
    return {f[i : i + 5] for i in range(len(f) - 4)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA1中ﬁ①é́Σ가ᄀ🙂")), max_size=60), min_size=1, max_size=6))
def test_batch_folding_equals_single_folding(texts):
    code, off = tx.fold_batch(texts)
    assert ["".join(map(chr, code[a:b])) for a, b in zip(off[:-1], off[1:])] == [tx._folded(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcd ,中文", max_size=80), min_size=2, max_size=4))
def test_agreement_equals_sets(texts):
    sets = tx.run_sets(texts)
    for i in range(len(texts)):
        a, b = plain_runs(texts[0]), plain_runs(texts[i])
        want = len(a & b) / len(a | b) if a and b else 0.0
        assert abs(tx.agreement(sets[0], sets[i]) - want) < 1e-12


def test_shared_run_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    for _ in range(50):
        same = word(35)
        code, off = tx.fold_batch([word(60) + same + word(20), word(11) + same + word(70)])
        f, at = tx.winnowed(code, off, 24, 12)
        assert set(f[at[0] : at[1]].tolist()) & set(f[at[1] : at[2]].tolist())


def test_long_hashes_depend_on_every_character():
    code = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"], dtype=np.uint32)
    base = tx.long_gram_hashes(code, 24)[0]
    for i in range(24):
        other = code.copy()
        other[i] += 1
        assert tx.long_gram_hashes(other, 24)[0] != base
