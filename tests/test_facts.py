"""Rules of representation facts, a case for each."""

import base64
import hashlib

from spanforge.operators import facts
from spanforge.operators.facts import derivation_violations, splits_pair, text_violations

SCHEMA = f"case_id string, content string, tier string, expected array<{facts.FACT_SPAN}>, representation {facts.REPRESENTATION}"


def step(codec, alphabet=None, padding=None, case=None, points=None):
    return (codec, alphabet, padding, case, points)


def span(start, end, value=None, via=None, fragments=None, role="secret", size=None):
    decoded = via and (via, "sha256:" + hashlib.sha256(value).hexdigest(), len(value) if size is None else size)
    return (start, end, role, fragments, decoded)


def test_facts_that_follow_from_the_text(spark):
    code = base64.b64encode(b"secret!").decode()
    b64 = step("base64", "standard", "padded")
    good = [
        ("whole", f"é{code}", [span(2, 2 + len(code), b"secret!", [b64])]),
        ("parts", f"{code[:4]}..{code[4:]}", [span(0, 2 + len(code), b"secret!", [b64], [(0, 4), (6, 2 + len(code))])]),
        ("strip", "s​e​c", [span(0, 9, b"sec", [step("strip-codepoints", points=["U+200B"])])]),
        ("twice", code.encode().hex(), [span(0, 2 * len(code), b"secret!", [step("hex", case="lower"), b64])]),
        ("unchecked", "x", [span(0, 1, b"y", [step("normalize")])]),
        ("none", "x", [span(0, 1)]),
    ]
    bad = {
        "upper": ("a decoding doesn't follow from the text", "0A", [span(0, 2, b"\n", [step("hex", case="lower")])]),
        "points": ("a decoding doesn't follow from the text", "sec", [span(0, 3, b"sec", [step("strip-codepoints", points=["U+200B"])])]),
        "length": ("decoded length or digest differs", code, [span(0, len(code), b"secret!", [b64], size=3)]),
        "inside": ("fragment is no range of the text", "éé", [span(0, 4, fragments=[(0, 1), (2, 4)])]),
        "touching": ("fragments aren't sorted, apart and disjoint", "abcd", [span(0, 4, fragments=[(0, 2), (2, 4)])]),
        "short": ("fragments don't make up the span", "abcd", [span(0, 4, fragments=[(0, 1), (2, 3)])]),
        "role": ("facts of a span that is no secret", "abcd", [span(0, 4, fragments=[(0, 1), (2, 4)], role="companion")]),
        "nothing": ("decoding without steps or bytes", "0a", [span(0, 2, b"", [step("normalize")])]),
    }
    rows = [(i, t, "T1", e, None) for i, t, e in good] + [(i, t, "T1", e, None) for i, (_, t, e) in bad.items()]
    found = {(r.case_id, r.reason) for r in text_violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(i, reason) for i, (reason, _, _) in bad.items()}
    assert text_violations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_representations(spark):
    pair = "a\U0001f511b"
    chunk = lambda *at, unit="utf16-code-unit": (unit, list(at))
    rows = [
        ("ok", pair, "T1", [], ("valid", None, chunk(1, 3))),
        ("split", pair, "T1", [], ("valid", None, chunk(2))),
        ("rejected", pair, "T0", [], ("unpaired-surrogate-split", None, chunk(2))),
        ("unsplit", pair, "T0", [], ("unpaired-surrogate-split", None, chunk(1))),
        ("tier", pair, "T1", [], ("unpaired-surrogate-split", None, chunk(2))),
        ("spans", pair, "T0", [span(0, 1)], ("unpaired-surrogate-split", None, chunk(2))),
        ("invalid", pair, "T0", [], ("invalid-utf8", None, chunk(1))),
        ("empty", pair, "T1", [], ("valid", None, None)),
        ("falling", pair, "T1", [], ("valid", None, chunk(3, 1))),
        ("outside", pair, "T1", [], ("valid", None, chunk(4))),
        ("bytes", pair, "T1", [], ("valid", None, chunk(6, unit="utf8-byte"))),
        ("authored", pair, "T1", [], ("valid", ("authored-base", ["x"]), None)),
        ("projected", pair, "T1", [], ("valid", ("projection", []), None)),
        ("double", pair, "T1", [], ("valid", ("projection", ["x", "x"]), None)),
        ("plain", None, "T1", [], None),
    ]
    found = {}
    for r in text_violations(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.case_id, set()).add(r.reason)
    assert found == {
        "split": {"a boundary splits a surrogate pair of valid input"}, "unsplit": {"no boundary splits a surrogate pair"}, "tier": {"a rejection isn't T0"}, "spans": {"a rejection has spans"},
        "invalid": {"input that no case can carry"}, "empty": {"representation without a fact"}, "falling": {"boundaries don't rise"}, "outside": {"boundary outside the text"}, "bytes": {"boundary outside the text"},
        "authored": {"an authored base has bases"}, "projected": {"a projection without bases or with too many"}, "double": {"a base is named twice"},
    }
    assert splits_pair("", [1]) is None and splits_pair("ab", []) is False


def test_derivations(spark):
    bases = {"a": [], "b": ["a"], "c": ["b", "a"], "x": ["y"], "y": ["z"], "z": ["x"], "tail": ["x", "a"], "far": ["tail"], "self": ["self"], "lost": ["nowhere"], "after": ["lost"]}
    bases |= {f"chain{k}": [f"chain{k - 1}"] if k else [] for k in range(12)}
    rows = [(i, "t", "T1", [], ("valid", ("projection" if b else "authored-base", b), None)) for i, b in bases.items()]
    found = {(r.case_id, r.reason) for r in derivation_violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(i, "derives from itself") for i in ("x", "y", "z", "tail", "far", "self")} | {("lost", "unknown base")}
