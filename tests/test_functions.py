"""JSON forms, hashes, signatures and versions, against known answers."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewarden.functions import crypto, jsons, messages, semver


def test_blake3_vectors():
    # official test vectors: input byte i is i % 251; first 8 bytes of the hash
    want = {0: "af1349b9f5f9a1a6", 1: "2d3adedff11b61f1", 63: "e9bc37a594daad83", 64: "4eed7141ea4a5cd4", 65: "de1e5fa0be70df6d", 1023: "10108970eeda3eb9", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2048: "e776b6028c7cd22a", 2049: "5f4d72f40d7a5f82", 3072: "b98cb0ff3623be03", 5120: "9cadc15fed8b5d85", 8192: "aae792484c8efe4f", 31744: "62b6960e1a44bcc1", 102400: "bc3e3d41a1146b06"}
    data = [bytes(i % 251 for i in range(n)) for n in want]
    assert [h.hex()[:16] for h in crypto.blake3_many(data)] == list(want.values())
    assert crypto.blake3_many(data, most=3) == crypto.blake3_many(data)
    assert crypto.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


def test_ed25519_rfc_vectors():
    for seed, public, message, head in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540"),
    ):
        key, mark = crypto.ed25519_sign(bytes.fromhex(seed), bytes.fromhex(message))
        assert key.hex() == public and mark.hex().startswith(head)
        assert crypto.ed25519_verify(key, bytes.fromhex(message), mark)
        assert not crypto.ed25519_verify(key, b"other", mark)
        assert not crypto.ed25519_verify(key, bytes.fromhex(message), mark[:32] + (int.from_bytes(mark[32:], "little") + crypto.ORDER).to_bytes(32, "little"))
    assert not crypto.ed25519_verify(b"short", b"", bytes(64))


def test_hash_columns(spark):
    row = spark.createDataFrame([(b"abc", None)], "a binary, b binary").select(crypto.short_hash(F.col("a"), "sha256"), crypto.short_hash(F.col("a"), "blake3"), crypto.short_hash(F.col("b"), "blake3")).first()
    assert row[0] == "sha256:" + hashlib.sha256(b"abc").hexdigest()[:32]
    assert row[1] == "blake3:6437b3ac38465133ffb63b75273a8db5" and row[2] is None
    with pytest.raises(ValueError):
        crypto.digest(F.col("a"), "md5")


@pytest.mark.parametrize(("raw", "canonical", "compact", "jcs"), [
    ('{"z":{"y":1,"x":2},"a":[3,1,2]}', '{"a":[3,1,2],"z":{"x":2,"y":1}}',) + ('{"a":[3,1,2],"z":{"x":2,"y":1}}',) * 2,
    ('[1.0, 1e21, -0, 1.5e-9, 0.00001, 1e16]', "[1,1000000000000000000000,-0,0.0000000015,0.00001,10000000000000000]", "[1.0,1e21,-0.0,1.5e-9,0.00001,1e16]", "[1,1e+21,0,1.5e-9,0.00001,10000000000000000]"),
    ("[18446744073709551615,-9223372036854775808]",) + ("[18446744073709551615,-9223372036854775808]",) * 2 + ("[18446744073709552000,-9223372036854776000]",),
    ('"\\u001b\\u0008\\/\\u00e9\\n\\"\\\\"',) + ('"\\u001b\\b/é\\n\\"\\\\"',) * 3,
    ('{"a":1,"a":2}',) + ('{"a":2}',) * 3,
    ('{"":1,"\U0001f600":2}', '{"":1,"\U0001f600":2}', '{"":1,"\U0001f600":2}', '{"\U0001f600":2,"":1}'),
    ("[333333333.33333329,1E30,4.50,2e-3,1e-27]", "[333333333.3333333,1000000000000000000000000000000,4.5,0.002,0.000000000000000000000000001]", "[333333333.3333333,1e30,4.5,0.002,1e-27]", "[333333333.3333333,1e+30,4.5,0.002,1e-27]"),
])
def test_json_forms(raw, canonical, compact, jcs):
    value = jsons.loads(raw)
    assert (jsons.canonical(value), jsons.compact(value), jsons.jcs(value)) == (canonical, compact, jcs)


@pytest.mark.parametrize("raw", ["", "{", "NaN", "[1,]", "1e999", "'x'", "[Infinity]"])
def test_what_is_no_json(spark, raw):
    with pytest.raises(ValueError):
        jsons.loads(raw)
    assert spark.createDataFrame([(raw,)], "r string").select(jsons.canonical_json("r")).first()[0] is None


@pytest.mark.parametrize(("raw", "target", "tool", "kind"), [
    ('{"method":"tools/call","id":1,"params":{"name":"t","arguments":{"b":1,"a":"x\\u001b"}}}', 't\n{"a":"x\\u001b","b":1}', "t", None),
    ('{"method":"ping","params":{"q":1}}', '{"q":1}', None, None),
    ('{"method":"tools/list"}', '{"method":"tools/list"}', None, "tools_list_request"),
    ('{"result":{"tools":[]}}', '{"result":{"tools":[]}}', None, "tools_list_response"),
    ('[{"method":"tools/call"}]', '[{"method":"tools/call"}]', None, None),
    ('{"method":"tools/call","params":{"name":7,"arguments":null}}', "null", None, None),
    ('{"method":"notifications/tools/list_changed","params":[1]}', "[1]", None, "tools_changed"),
])
def test_messages(raw, target, tool, kind):
    made = messages.describe(raw)
    assert (made["target"], made["tool"], made["kind"]) == (target, tool, kind)


def test_versions(spark):
    def holds(version, need):
        parts = semver.requirement(need)
        if parts is None:
            return None
        v = semver.parsed(F.lit(version))
        return spark.range(1).select(semver.covers(v, parts)).first()[0]

    yes = [("2.3.9", "<2.4.0"), ("v1.0.0", ">=1.0.0, <2.0.0"), ("1.9.0", "^1.2.3"), ("1.2.9", "~1.2.3"), ("0.2.5", "^0.2.3"), ("0.0.3", "^0.0.3"), ("1.2.3", "1.2.3"), ("5.0.0", "*"), ("1.4.2", "1.*"), ("1.2.3-rc.1", ">=1.2.3-alpha"), ("1.2.3", "=1.2"), ("1.3.0", ">1.2"), ("1.2.9", "<=1.2"), ("1.2.3+build", "1.2.3")]
    no = [("2.4.0", "<2.4.0"), ("2.3.0-rc.1", "<2.4.0"), ("2.0.0", "^1.2.3"), ("1.3.0", "~1.2.3"), ("0.3.0", "^0.2.3"), ("0.0.4", "^0.0.3"), ("1.2.4", "=1.2.3"), ("1.2.9", ">1.2"), ("1.2.3-alpha", ">=1.2.3-rc"), ("1.2.3-2", ">=1.2.3-10")]
    assert [holds(*x) for x in yes] == [True] * len(yes)
    assert [bool(holds(*x)) for x in no] == [False] * len(no)
    assert [semver.requirement(x) for x in ("nonsense", "", "1.2.3.4", ">>1")] == [None] * 4
    bad = spark.createDataFrame([("1.2",), ("01.2.3",), ("x",), (None,)], "v string")
    assert {r[0] for r in bad.select(semver.parsed(F.col("v"))).collect()} == {None}
