import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import suffixes


def check(data):
    t = np.frombuffer(data, np.uint8)
    sa = suffixes.suffix_array(t)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert sa.tolist() == want
    plcp = suffixes.permuted_lcp(t, sa)
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert plcp[b] == n
    if len(data):
        assert plcp[want[0]] == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.lists(st.sampled_from(b"ab"), max_size=200).map(bytes) | st.lists(st.sampled_from(b"aab\xff\x00"), max_size=120).map(bytes))
def test_any_bytes(data):
    check(data)


def test_fixed():
    for d in [b"", b"a", b"aaaaaaa", b"banana", b"mississippi" * 30, bytes(range(256)) * 2, b"abracadabra" * 50 + b"\xff" + b"abracadabra" * 49, b"a" * 900 + b"b" * 900]:
        check(d)
