"""Headers of signed tokens of any length."""

import base64
import random
import time

from billsift.llm import secrets


def coded(x: bytes) -> str:
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_a_header_may_be_of_any_length():
    for pad in (10, 4_000, 100_000):
        head = coded(b'{"x5c":["' + b"QUJD" * pad + '","é"],"alg":"RS256"}'.encode())
        token = f"{head}.{coded(b'{"sub":1}')}.c2ln"
        for before in ("", "z", "eyJ", "eyJzeyJ"):
            text = before + token
            assert [text[a:b] for a, b in secrets.signed_in(text)] == [token]


def test_a_header_is_found_as_by_trying_each_start():
    rng = random.Random(7)
    parts = [b'{"', b'"', b"}", b":", b'"alg":"x"', b'{"alg":"x"}', b",", b" ", b"[", b"]", b"1", "é".encode(), b"\xff", b'{"a":', b"\n", b'\\"']
    hits = 0
    for _ in range(20_000):
        head = "".join(rng.choice(["", "e", "ab"]) + coded(b"".join(rng.choices(parts, k=rng.randrange(1, 6)))) for _ in range(rng.randrange(1, 3)))
        want = next((k for k in range(len(head)) if head.startswith("eyJ", k) and isinstance((secrets._object(head[k:]) or {}).get("alg"), str)), None)
        assert secrets.header_in(head) == want
        hits += want is not None
    assert hits > 50


def test_long_headers_take_no_square_time():
    for inside in (b'{":' * 250_000, b'{"a":' * 150_000, b'{"a":1,' * 100_000, b'{"a' * 250_000, b'["{",' * 150_000, b'{"a":' * 900 + b"1," * 300_000):
        start = time.time()
        assert list(secrets.signed_in(f"{coded(inside + b'}')}.{coded(b'{}')}.x")) == [] and time.time() - start < 15
