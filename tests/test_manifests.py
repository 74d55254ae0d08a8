"""Fingerprints, drift, baselines, collisions, audit, trust, feed."""

from __future__ import annotations

import base64
import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.functions import crypto, jsons
from tidewarden.operators import audit, feed, identity, manifest, trust


def tools(*names, described="does it", params=("q",), required=None, key="inputSchema"):
    return [{"name": n, "description": described, key: {"type": "object", "properties": {p: {"type": "string"} for p in params}, "required": list(params if required is None else required)}} for n in names]


def listed(found):
    return json.dumps({"jsonrpc": "2.0", "id": 1, "result": {"tools": found}})


WEATHER = listed([{"name": "get_weather", "description": "weather", "inputSchema": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}}])


def test_known_fingerprints(spark):
    df = spark.createDataFrame([("/bin/x", WEATHER), ("/bin/x", listed([])), ("/bin/x", '{"result":{}}'), ("/bin/x", listed([{"description": "nameless"}])), ("/bin/x", None)], "program string, raw string")
    rows = manifest.fingerprints(df, backend="sha256").collect()
    assert rows[0].aggregate_hash == "sha256:f2d844b3957f70b0a800ff2f4afcf284"
    assert rows[0].tools[0].description_hash == "sha256:e5e72beb4e3c6926d3dc9e3e2ef7833b"
    assert rows[0].tools[0].required_set_hash == "sha256:4cc4e43fec2c4c157b82cb762575c28a"
    assert rows[1].aggregate_hash == "sha256:5dfda64a78222225db33334862cdc26d" and rows[1].tools_count == 0
    assert [r.tools for r in rows[2:]] == [None] * 3 and [r.aggregate_hash for r in rows[2:]] == [None] * 3
    blake = manifest.fingerprints(df, backend="blake3").first()
    assert blake.aggregate_hash.startswith("blake3:") and len(blake.aggregate_hash) == 7 + 32
    with pytest.raises(ValueError):
        manifest.fingerprints(df, backend="md5")


def test_tools_are_parsed_one_at_a_time():
    plain = listed(tools("b", "a", "é"))
    raws = [plain, listed([]), "", "{", "[]", "{}", '{"result":1}', '{"result":{"tools":{}}}', plain + " x", "\ufeff" + plain, " \n" + plain + "\t", plain[:-1], plain[:-2] + ",}}", plain[:-1] + ',"result":{"tools":[]}}', plain[:-2] + ',"tools":[{"name":"z"}]}}', '{"result":{"tools":[1]}}', '{"result":{"tools":[{"name":1}],"tools":[{"name":"x"}]}}', '{"result":{"tools":[{"name":"x"},]}}', '{"result":{"tools":[{"name":"x","v":NaN}]}}', '{"result" : { "n":[1,{"a":2}] , "tools" : [ {"name":"x"} , {"name":"y"} ] } , "id":1.0}', '{"result":{"tools":[{"name":"x"}]},"id":}']
    for raw in raws:
        whole = manifest.tools_of(raw)
        try:
            assert whole is None or list(jsons.items(raw, "result", "tools")) == whole
        except ValueError:
            pass  # left to the whole parser
        (made,) = manifest.fingerprint_many(["p"], [raw])
        assert (made and sorted(t["name"] for t in made["tools"])) == (whole if whole is None else sorted(t["name"] for t in whole))
    assert [manifest.tools_of(r) is None for r in raws].count(False) == 7
    assert list(jsons.items(raws[10], "result", "tools")) == manifest.tools_of(plain)


def test_a_large_manifest_takes_memory_like_its_text():
    raw = listed(tools(*(f"tool_{k}" for k in range(20000)), described="d" * 300, params=[f"param_{k}" for k in range(8)]))
    manifest.line_lists(["p"], [listed(tools("a"))], "sha256", True)
    tracemalloc.start()
    try:
        ((lines, _),) = manifest.line_lists(["p"], [raw], "sha256", True)
        assert len(lines) == 20000 and tracemalloc.get_traced_memory()[1] < 1.5 * len(raw)
    finally:
        tracemalloc.stop()


def latest(pieces):
    found = None
    try:
        for x in jsons.items_in(pieces, "result", "tools"):
            if x is jsons.START or x is jsons.GONE:
                found = [] if x is jsons.START else None
            else:
                found.append(x)
    except ValueError:
        return None
    return found


def test_manifests_are_read_in_pieces():
    plain = listed(tools("b", "é😀", described='\\ "[{,'))
    raws = [plain, "", "{", plain[:-1], plain + "x", " \n" + plain + "\t", plain[:-1] + ',"result":{"tools":[]}}', plain[:-1] + ',"result":1}', plain[:-2] + ',"tools":[{"name":"z"}],"tools":[{"name":"y"}]}}', plain[:-2] + ',"tools":{}}}', '{"result":{"tools":[12.5e3,12,-0,"\\ud83d\\ude00",true,{"a":[1E5 , 2]}]},"id":1e2}', '{"result":{"tools":[1e999]}}', '{"result":{"tools":[-Infinity]}}', '{"result":{"tools":[1],"tools":[2,]}}', '{"result":{"tools":[' + "9" * 350 + ".5e-300]}}"]
    for raw in raws:
        try:
            whole = jsons.loads(raw)["result"]["tools"]
        except (ValueError, TypeError):
            whole = None
        for size in (1, 2, 3, 7, 40, 1000):
            assert latest(raw[k : k + size] for k in range(0, len(raw), size)) == (whole if isinstance(whole, list) else None)


def test_blake3_in_pieces():
    for size in (0, 1, 1024, 4096, 4097, 8192, 8193, 12289, 20000, 70000):
        data = bytes(k * k % 251 for k in range(size))
        made = crypto.Blake3(most=4)
        for k in range(0, size, 1500):
            made.update(data[k : k + 1500])
        assert made.digest() == crypto.blake3(data)


@pytest.mark.parametrize("backend", ["sha256", "blake3"])
def test_large_manifests(spark, backend, monkeypatch):
    monkeypatch.setattr(manifest._Sorted.__init__, "__defaults__", (700, 50))
    large = tools(*(f"é{k % 2500}😀" for k in range(4000)), described="d" * 300, params=("q", "é"))
    for k, tool in enumerate(large):
        tool["description"] += str(k)
    raw, small = json.dumps(json.loads(listed(large)), ensure_ascii=False), listed(tools("b", "a"))
    assert len(raw) > 1 << 20
    raws = [small, raw, None, raw[:-1], listed([]), raw[:-2] + ',"tools":[{"name":"z"}]}}', raw[:-1] + ',"result":1}', raw.replace('"name": "é9😀"', '"name": 9'), small, "x" * (1 << 21)]
    want = manifest.fingerprint_many([f"p{k}" for k in range(len(raws))], raws, backend)
    assert [w and len(w["tools"]) for w in want] == [2, 4000, None, None, 0, 1, None, None, 2, None]
    assert want[1]["aggregate_hash"] == manifest._short([b"p1" + (4000).to_bytes(8, "little") + b"".join(manifest._hashed(list(t.values())) for t in want[1]["tools"])], backend).__next__()
    df = spark.createDataFrame([(f"p{k}", k, r) for k, r in enumerate(raws)], "program string, k int, raw string").coalesce(1)
    rows = manifest.fingerprints(df, backend=backend).collect()
    assert [(r.k, r.raw, r.aggregate_hash, r.tools and [t.asDict() for t in r.tools]) for r in rows] == [(k, r, w and w["aggregate_hash"], w and w["tools"]) for k, (r, w) in enumerate(zip(raws, want))]
    assert [(r.program, r.tools_count, r.aggregate_hash) for r in manifest.aggregates(df, backend=backend).collect()] == [(f"p{k}", w and len(w["tools"]), w and w["aggregate_hash"]) for k, w in enumerate(want)]
    assert [r.asDict() for r in manifest.tool_rows(df, backend=backend, keep=("k",)).collect()] == [{"k": k} | t for k, w in enumerate(want) if w for t in w["tools"]]
    bad = spark.range(1).selectExpr("'p' AS program", "cast(x'7bff7d' AS string) AS raw")
    assert manifest.aggregates(bad, backend=backend).first().tools_count is None


def test_memory_of_a_large_manifest_does_not_grow(monkeypatch):
    monkeypatch.setattr(manifest._Sorted.__init__, "__defaults__", (1 << 10, 8))
    monkeypatch.setattr(manifest, "TOOLS", 256)
    peaks = []
    for count in (1, 6000, 18000):
        text = listed(tools(*(f"tool_{k}" for k in range(count)), params=[f"param_{k}" for k in range(4)])).encode()
        batches = (pa.RecordBatch.from_pylist([{"_row": None if k else 7, "_program": None if k else "p", "_piece": text[k : k + 2000], "_size": None if k else len(text)}], pa.schema({"_row": pa.int32(), "_program": pa.string(), "_piece": pa.binary(), "_size": pa.int32()})) for k in range(0, len(text), 2000))
        tracemalloc.start()
        try:
            assert sum(len(read[3].values) for read in manifest._read(batches, "sha256", False, "blocks")) == count
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[2] < 1.5 * peaks[1] and peaks[2] < len(text) / 4  # thrice the text; a block a run more


def snapshots(spark, *rows):
    return spark.createDataFrame([(p, i, f"2024-01-{i + 1:02}T00:00:00Z", raw) for i, (p, raw) in enumerate(rows)], "program string, seq int, ts_iso string, raw string")


@pytest.mark.parametrize("backend", ["sha256", "blake3"])
def test_drift_kinds(spark, backend):
    a = tools("a", "b")
    df = snapshots(spark, ("p", listed(a)), ("p", listed(a[::-1])), ("p", listed(tools("a", "b", described="other"))), ("p", listed(tools("a", "b", "c"))), ("p", listed(tools("a"))), ("p", listed(tools("a", "b", params=("q", "r"), required=("q",)))), ("p", listed(tools("a", "b", required=()))), ("p", listed(tools("a​", "b"))), ("p", '{"result":{}}'), ("q", listed([])), ("q", listed(a)), ("p", listed(tools("a", "b", key="parameters"))))
    out, after = manifest.observe(df, backend=backend)
    rows = out.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["unknown", "match", "drift", "drift", "drift", "drift", "drift", "match", "error", "unknown", "drift", "match"]
    assert rows[2].detail.description_changed == ["a", "b"] and rows[2].baseline_iso == "2024-01-01T00:00:00Z"
    assert rows[3].detail.added == ["c"] and rows[4].detail.removed == ["b"]
    assert [(x.tool, x["from"], x["to"]) for x in rows[5].detail.params_changed] == [("a", ["q"], ["q", "r"]), ("b", ["q"], ["q", "r"])]
    assert [(x["from"], x["to"]) for x in rows[6].detail.params_changed] == [(["q"], ["q"])] * 2
    assert rows[10].detail.added == ["a", "b"]
    pins = {r.program: r for r in after.collect()}
    assert pins["p"].baseline_iso == "2024-01-01T00:00:00Z" and pins["p"].last_seen_iso == "2024-01-12T00:00:00Z"
    assert pins["q"].last_seen_iso == pins["q"].baseline_iso == "2024-01-10T00:00:00Z"
    # the same on the caller's side
    plain = manifest.fingerprint("p", listed(a), backend)
    assert plain["aggregate_hash"] == rows[0].aggregate_hash
    assert manifest.difference(plain["tools"], manifest.fingerprint("p", listed(tools("a", "b", "c")), backend)["tools"])["added"] == ["c"]


def test_baselines_keep_their_backend(spark):
    _, pins = manifest.observe(snapshots(spark, ("p", listed(tools("a")))), backend="sha256")
    out, after = manifest.observe(snapshots(spark, ("p", listed(tools("a"))), ("p", listed(tools("z"))), ("new", listed(tools("a")))), pins, backend="blake3", jcs=True)
    assert [r.kind for r in out.orderBy("seq").collect()] == ["match", "drift", "unknown"]
    assert {r.program: (r.hash_backend, r.jcs_canonical) for r in after.collect()} == {"p": ("sha256", False), "new": ("blake3", True)}


def test_baseline_tables(spark):
    _, pins = manifest.observe(snapshots(spark, ("p", listed(tools("a"))), ("q", listed(tools("b")))), backend="sha256")
    new = spark.createDataFrame([("p", listed(tools("z"))), ("r", listed([]))], "program string, raw string")
    trusted = manifest.re_baseline(pins, new, "2025-01-01T00:00:00Z")
    assert {r.program: r.tools_count for r in trusted.collect()} == {"p": 1, "q": 1, "r": 0}
    assert {r.program for r in manifest.forget(trusted, "p").collect()} == {"q", "r"}
    assert {r.program for r in manifest.prune(trusted, "2024-06-01T00:00:00Z").collect()} == {"p", "r"}
    merged = manifest.merge(pins.where("program = 'p'"), trusted)
    assert {r.program: r.baseline_iso[:4] for r in merged.collect()} == {"p": "2024", "q": "2024", "r": "2025"}


def test_stamp():
    base = manifest.fingerprint("p", WEATHER, "sha256") | {"baseline_iso": "2024-01-01T00:00:00Z"}
    once = manifest.stamp(WEATHER, base, "key", "1")
    assert json.loads(once)["result"]["_meta"]["key"]["aggregate_hash"] == base["aggregate_hash"]
    assert manifest.stamp(once, base, "key", "1") == once
    assert manifest.stamp('{"result":1}', base, "key", "1") == '{"result":1}'


def test_identity(spark):
    made = manifest.fingerprints(spark.createDataFrame([("p", listed(tools("send_message", "read_file", "Read_File", described="d"))), ("q", listed(tools("x", described="d")))], "program string, raw string"), backend="sha256")
    calls = spark.createDataFrame([("p", n) for n in ("send_message​", "ѕend_mеssagе", "send_message", "READ_FILE", "other", "​", None)] + [("z", "send_message​")], "program string, tool string")
    got = {(r.program, r.tool): r.collision for r in identity.with_collisions(calls, made).collect()}
    assert got == {("p", "send_message​"): "send_message", ("p", "ѕend_mеssagе"): "send_message", ("p", "send_message"): None, ("p", "READ_FILE"): "Read_File", ("p", "other"): None, ("p", "​"): None, ("p", None): None, ("z", "send_message​"): None}
    assert [(r.program, r.other, r.other_name) for r in identity.shadows(made).collect()] == [("p", "q", "x")]


def test_audit(spark):
    log = spark.createDataFrame([(i, f"2024-01-{i + 1:02}T00:00:00Z", "inbound" if i % 2 else "outbound", ["a", "b"][: i % 3], []) for i in range(20)], "seq long, ts_iso string, direction string, matched_patterns array<string>, cve_refs array<string>")
    seqs = lambda **o: [r.seq for r in audit.view(log, **o).collect()]
    assert seqs(cap=5) == [15, 16, 17, 18, 19]
    assert seqs(cap=5, limit=2) == [15, 16]
    assert seqs(cap=5, since="2024-01-18T00:00:00Z") == [17, 18, 19]
    assert audit.total(log).first()[0] == 20
    assert audit.report(log).where("pattern = 'b'").agg(F.sum("blocks")).first()[0] == 6
    values = spark.range(1, 101).selectExpr("cast(id AS double) AS v")
    assert [r.value for r in audit.nearest_rank(values, "v").collect()] == [51.0, 99.0, 100.0, 100.0]
    assert audit.nearest_rank(values.limit(0), "v").count() == 0


def signed(server, raw, seed=13, alter=None):
    key, mark = crypto.ed25519_sign(bytes([seed]) * 32, jsons.canonical(jsons.loads(raw)).encode())
    return server, alter or raw, base64.b64encode(key).decode(), base64.b64encode(mark).decode()


def test_verification(spark):
    good = signed("s", '{"b":1,"a":[1.0]}')
    rows = [good, ("s", '{"a":[1], "b":1}', *good[2:]), signed("s", WEATHER, alter="{}"), ("s", "{}", "AAAA", good[3]), ("s", "{}", "?", good[3]), ("s", "{}", good[2], "AAAA"), ("s", "{", *good[2:]), ("s", "{}", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, server_name string, raw string, public_key_b64 string, signature_b64 string")
    out = trust.verify(df).orderBy("seq").collect()
    assert [r.valid for r in out] == [True, True, False, False, False, False, False, False]
    assert out[0].key_fingerprint == crypto.blake3(base64.b64decode(good[2])).hex()[:32] and out[0].error is None
    assert [r.error for r in out[2:]] == ["signature did not verify", "key: expected 32 bytes, got 3", "public key is no base64", "signature: expected 64 bytes, got 3", "manifest is no JSON", "public key is no base64"]


def test_trust_on_first_use(spark):
    raw = "{}"
    rows = [signed("s", raw, alter="[]"), signed("s", raw), signed("s", raw, 7), signed("s", raw), signed("t", raw), signed("s", raw, alter="[]")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, server_name string, raw string, public_key_b64 string, signature_b64 string")
    pins = spark.createDataFrame([], trust.PIN)
    out, after = trust.verify_with_pins(df, pins, True, "now")
    rows = out.orderBy("seq").collect()
    assert [bool(r.valid) for r in rows] == [False, True, False, True, True, False]
    assert [r.pin_outcome for r in rows] == [None, "newly_pinned", None, "already_pinned", "newly_pinned", "already_pinned"]
    assert "mismatch" in rows[2].error and "not pinned" in rows[0].error
    assert after.count() == 2
    out, same = trust.verify_with_pins(df, pins, False, "now")
    assert not any(r.valid for r in out.collect()) and same.count() == 0
    out, same = trust.verify_with_pins(df, after, False, "now")
    assert [bool(r.valid) for r in out.orderBy("seq").collect()] == [False, True, False, True, True, False] and same.count() == 2
    key = signed("s", raw)[2]
    assert trust.pin(after, "s", key, "later").where("server_name = 's'").first().pinned_at_iso == "now"
    with pytest.raises(ValueError):
        trust.pin(after, "s", signed("s", raw, 7)[2], "later")
    with pytest.raises(ValueError):
        trust.pin(after, "u", "AAAA", "later")
    assert trust.unpin(after, "s").count() == 1


def test_bundles(spark):
    mark = base64.b64encode(bytes(64)).decode()
    rekor = lambda s: {"base64Signature": "c2ln", "cert": "PEM", "rekorBundle": {"SignedEntryTimestamp": s, "Payload": {"logIndex": 5, "integratedTime": 9}}}
    raws = [json.dumps(x) for x in (rekor(mark), rekor("AAAA"), {"base64Signature": "c2ln"}, {"base64Signature": " "}, {}, rekor("?"), {"base64Signature": "c2ln", "rekorBundle": 3})] + ["{", json.dumps({"base64Signature": "x" * (1 << 20)})]
    out = trust.check_bundles(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()
    assert [r.bundle_parsed for r in out] == [True, True, True] + [False] * 6
    assert [r.shape_only_ok for r in out[:3]] == [True, False, False]
    assert (out[0].log_index, out[0].integrated_time, out[0].has_cert, out[2].has_rekor_bundle, out[1].set_bytes) == (5, 9, True, False, 3)
    assert [r.error for r in out[3:]] == ["base64Signature is missing"] * 2 + ["timestamp is no base64", "rekorBundle is malformed", "bundle is no JSON", f"bundle exceeds {1 << 20} bytes: {(1 << 20) + 23}"]


def test_log_lookup(spark):
    df = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, "{}")], "id int, raw string")
    log = trust.artifact_hash(df.limit(1)).select("artifact_sha256", F.lit("u").alias("uuid"), F.lit(3).alias("log_index"))
    assert {r.id: r.uuid for r in trust.log_lookup(df, log).collect()} == {1: "u", 2: None}


def test_feed(spark):
    df = spark.createDataFrame([("FastMCP", "2.3.9"), ("fastmcp", "v2.4.0"), ("fastmcp", "2.4"), ("fastmcp", None), ("n/a", "1.0.0"), ("nothing", "1.0.0"), ("", "9.9.9"), (None, None)], "server_name string, server_version string")
    got = {}
    for r in feed.check(df).collect():
        got.setdefault((r.server_name, r.server_version), []).append(r.id)
    assert got[("FastMCP", "2.3.9")] == ["CVE-2026-27124"] == got[("fastmcp", "2.4")] == got[("fastmcp", None)]
    assert ("fastmcp", "v2.4.0") not in got and ("nothing", "1.0.0") not in got and len(got[("n/a", "1.0.0")]) == 5
    assert len(got[("", "9.9.9")]) == 5
    assert feed.find(feed.feed_df(spark), "cve-2026-27124").count() == 1
    assert {r.pattern: r.cve_refs for r in feed.by_pattern(feed.feed_df(spark)).collect()}["localhost_callback"] == ["CVE-2025-49596", "CVE-2026-42559"]
    ages = spark.range(1).select(feed.age_days(F.lit("2026-06-07").cast("date")), feed.age_days(F.current_date(), "soon")).first()
    assert tuple(ages) == (10, -1)
    own = feed.parse_feed('[[cves]]\nid="X"\nseverity="low"\ntitle="t"\nfixed_in="a>=2"\naffected_versions=">=1.0.0, <2.0.0"\nsimulate_payload="p"\nexpected_pattern_id="javascript_uri"\n')
    one = spark.createDataFrame([("a", "1.5.0"), ("a", "0.9.0")], "server_name string, server_version string")
    assert [r.server_version for r in feed.check(one, feed=own).collect()] == ["1.5.0"]
    with pytest.raises(ValueError):
        feed.parse_feed('[[cves]]\nid="X"\nseverity="dire"\ntitle="t"\nfixed_in="a"\nsimulate_payload="p"\nexpected_pattern_id="q"\n')
