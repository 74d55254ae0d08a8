"""Tables, streams, the inspection tools, the command line and the registered queries."""

from __future__ import annotations

import json
import os
import threading
import time

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.test_manifests import WEATHER, listed, signed, tools
from tidewarden import cli
from tidewarden.api import TOOLS, Inspector
from tidewarden.operators.policy import Policy
from tidewarden.plans import queries as plans
from tidewarden.sources import lines
from tidewarden.sources.store import AUDIT, PINS, Log, Table
from tidewarden.sources.work import numbered
from tidewarden.streaming import drift, messages


def test_tables(spark, tmp_path):
    table = Table(spark, str(tmp_path / "pins"), PINS)
    assert table.read().count() == 0

    def add(k):
        table.update(lambda old: old.unionByName(spark.createDataFrame([(f"s{k}", "f", "k", "t")], PINS)))

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.server_name for r in table.read().collect()} == {"s0", "s1", "s2", "s3"}
    assert len([p for p in (tmp_path / "pins").iterdir() if p.name.startswith("v-")]) <= 2
    with table.lock(), pytest.raises(TimeoutError), Table(spark, table.path, PINS).lock(wait=0.1):
        pass
    (tmp_path / "pins" / "_current").write_text("99 v-x")
    (tmp_path / "pins" / "._current.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        table.read()


def test_lines(spark, tmp_path):
    (tmp_path / "in.ndjson").write_text('{"id":1}\n\n{"id":2}\n')
    df = lines.read_lines(spark, str(tmp_path / "in.ndjson"), "inbound", "p")
    assert [r.raw for r in df.orderBy("seq").collect()] == ['{"id":1}', "", '{"id":2}']
    with pytest.raises(ValueError):
        lines.read_lines(spark, str(tmp_path), "sideways", "p")


def test_stream_rereads_the_policy(spark, tmp_path):
    call = '{"id":1,"method":"tools/call","params":{"name":"t","arguments":{"q":"$(x)"}}}\n'
    (tmp_path / "in").mkdir()
    path = tmp_path / "policy.toml"
    base = 'fail_mode = "%s"\nscan_unicode = true\nversion = "1"\n'
    source = messages.PolicySource(str(path))
    seen = []
    for k, (text, name) in enumerate(((base % "closed", "block"), (base % "open", "warn"), ("fail_mode =", "warn"))):
        path.write_text(text)
        (tmp_path / "in" / f"{k}.ndjson").write_text(call)
        stream = lines.stream_lines(spark, str(tmp_path / "in"), "inbound", "p")
        messages.run(stream, source, str(tmp_path / "out"), str(tmp_path / "check"), lambda: "2024-01-01T00:00:00Z").awaitTermination()
        seen.append(name)
    got = spark.read.parquet(str(tmp_path / "out" / "messages")).orderBy("batch").collect()
    assert [r.action for r in got] == seen and source.error
    log = Log(spark, str(tmp_path / "out" / "audit"), AUDIT)
    assert [r.seq for r in log.read().orderBy("seq").collect()] == [1, 2, 3]
    assert (tmp_path / "out" / "forwarded").is_dir() and got[0].seq == 0 and got[1].seq == 1 << 40


def test_a_micro_batch_of_one_file_uses_all_cores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.ndjson").write_text("".join(f'{{"id":{k},"method":"ping"}}\n' for k in range(40)))
    stream = lines.stream_lines(spark, str(tmp_path / "in"), "inbound", "p")
    messages.run(stream, Policy, str(tmp_path / "out"), str(tmp_path / "check"), lambda: "2024-01-01T00:00:00Z").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "messages"))
    assert len(out.inputFiles()) == spark.sparkContext.defaultParallelism
    assert [(r.seq, json.loads(r.raw)["id"]) for r in out.orderBy("seq").collect()] == [(k, k) for k in range(40)]
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out" / "forwarded")).collect()] == list(range(40))


def test_numbers_are_gapless_in_any_number_of_partitions(spark):
    got = numbered(spark.range(300).repartition(200), 10).collect()
    assert sorted(r.seq for r in got) == list(range(10, 310))
    assert numbered(spark.range(0)).count() == 0


def test_a_lock_nobody_renews_is_taken(spark, tmp_path):
    table = Table(spark, str(tmp_path / "pins"), PINS)
    (tmp_path / "pins").mkdir()
    (tmp_path / "pins" / "_lock").write_text("")
    os.utime(tmp_path / "pins" / "_lock", (1, 1))
    with table.lock(wait=5):
        assert (tmp_path / "pins" / "_lock").exists()
        with pytest.raises(TimeoutError), Table(spark, table.path, PINS).lock(wait=0.2):
            pass
    assert not list((tmp_path / "pins").glob("_*"))
    with table.lock(stale=0.4):  # renewed as long as it is held
        time.sleep(1)
        with pytest.raises(TimeoutError), Table(spark, table.path, PINS).lock(wait=0.2, stale=0.4):
            pass


def test_appends_are_numbered_once(spark, tmp_path):
    log = Log(spark, str(tmp_path / "audit"), AUDIT)
    entry = lambda *marks: spark.createDataFrame([(m, "inbound", [], []) for m in marks], AUDIT.partition(", ")[2])
    log.append(entry("a", "b"), "one")
    log.append(entry(), "none")
    log.append(entry("c"), "two")
    log.append(entry("A", "B"), "one")
    log.append(entry("d"))
    assert [(r.seq, r.ts_iso) for r in log.read().orderBy("seq").collect()] == [(1, "A"), (2, "B"), (3, "c"), (4, "d")]


def test_drift_steps():
    base, kinds = None, []
    for k, raw in enumerate((listed([]), listed([]), "{", listed(tools("a")), listed([]))):
        out, base = drift.step("p", {"raw": raw, "seq": k, "ts_iso": f"t{k}"}, base, "sha256", False)
        kinds.append(out["kind"])
    assert kinds == ["unknown", "match", "error", "drift", "match"] and base["last_seen_iso"] == "t4"


def test_a_call_of_the_stream_takes_many_programs():
    class State(dict):
        getValue = dict.get

        def updateValue(self, key, value):
            self[key] = value

    held = State()
    processor = drift.Drift("sha256")
    processor.init(type("Handle", (), {"getMapState": lambda *_: held})())
    plain, more = listed(tools("a")), listed(tools("a", "b"))
    old = drift.manifest.fingerprint("old", plain, "blake3", True) | {"baseline_iso": "t", "last_seen_iso": "t"}
    held[("old",)] = (json.dumps(old),)
    rows = [("p", 3, more), ("q", 2, "{"), ("p", 1, plain), ("old", 4, plain), ("old", 5, more), ("q", 6, more)]
    frames = (pd.DataFrame([{"program": p, "seq": k, "ts_iso": f"t{k}", "raw": raw}]) for p, k, raw in rows)
    (out,) = processor.handleInputRows((0,), frames, None)
    assert [(r.program, r.seq, r.kind) for r in out.itertuples()] == [("p", 1, "unknown"), ("q", 2, "error"), ("p", 3, "drift"), ("old", 4, "match"), ("old", 5, "drift"), ("q", 6, "unknown")]
    after = {k[0]: json.loads(v[0]) for k, v in held.items()}
    assert {p: (b["hash_backend"], b["baseline_iso"], b["last_seen_iso"]) for p, b in after.items()} == {"p": ("sha256", "t1", "t1"), "q": ("sha256", "t6", "t6"), "old": ("blake3", "t", "t4")}


@pytest.fixture()
def inspector(spark, tmp_path):
    return Inspector(spark, str(tmp_path / "home"))


def test_tools(inspector):
    ask = lambda method, **params: inspector.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    call = lambda name, **args: ask("tools/call", name=name, arguments=args)["result"]
    assert ask("initialize")["result"]["serverInfo"]["name"] == "tidewarden"
    assert ask("ping")["result"] == {} and len(ask("tools/list")["result"]["tools"]) == len(TOOLS) == 10
    assert inspector.handle("{")["error"]["code"] == -32700
    assert inspector.handle("{}")["error"]["code"] == -32600
    assert ask("none")["error"]["code"] == -32601
    assert inspector.handle('{"method":"none"}') is None
    assert call("scan_payload", payload="hi", direction="inbound")["structuredContent"]["verdict"] == "allow"
    assert call("scan_payload", payload="$(x)", direction="inbound")["structuredContent"]["matched_patterns"] == ["shell_substitution"]
    assert call("scan_payload", payload="x", direction="up")["isError"] and call("scan_payload")["isError"] and call("other")["isError"]
    blocked = call("list_blocked")["structuredContent"]
    assert blocked["total"] == 1 and blocked["blocked_calls"][0]["direction"] == "inbound"
    assert call("get_policy")["structuredContent"]["fail_mode"] == "closed"
    checked = call("check_cve", server_name="rmcp", server_version="1.3.0")["structuredContent"]
    assert [r["id"] for r in checked["affected_cves"]] == ["CVE-2026-42559"] and checked["version_match_used"]
    assert call("simulate_attack", cve_id="cve-2026-30623")["structuredContent"]["actual_verdict"] == "block"
    assert call("simulate_attack", cve_id="CVE-0")["isError"]
    assert call("get_keystore")["structuredContent"] == {"pinned_entries": [], "count": 0}
    assert call("verify_bundle", bundle_json='{"base64Signature":"c2ln"}')["structuredContent"]["shape_only_ok"] is False
    assert call("verify_bundle", bundle_json="{}")["isError"] and call("rekor_lookup", tools_list_response={})["isError"]
    _, raw, key, mark = signed("s", WEATHER)
    assert call("verify_manifest", tools_list_response=json.loads(raw), public_key_b64=key, signature_b64=mark)["structuredContent"]["valid"]
    assert call("verify_manifest", tools_list_response={}, public_key_b64="x", signature_b64=mark)["isError"]
    assert call("get_drift_history", program="p")["structuredContent"] == {"program": "p", "baseline_present": False}


def test_command_line(spark, tmp_path, capsys):
    home, file = str(tmp_path / "home"), tmp_path / "m.json"
    _, raw, key, mark = signed("s", WEATHER)
    file.write_text(raw)
    run = lambda *args: cli.main(["--home", home, *map(str, args)], spark)
    out = lambda: json.loads(capsys.readouterr().out)
    assert run("version") == 0 and run("scan", "fine") == 0 and run("scan", "$(x)") == 3
    assert run("verify", file, key, mark) == 0
    file.with_name("n.json").write_text("{}")
    assert run("verify", file.with_name("n.json"), key, mark) == 2
    assert run("verify", file, key, mark, "--server", "s") == 2
    assert run("verify", file, key, mark, "--server", "s", "--pin-on-first-use") == 0
    assert run("verify", file, key, mark, "--server", "s") == 0
    capsys.readouterr()
    assert run("keystore", "list") == 0 and out()["count"] == 1
    assert run("keystore", "pin", "s", "--pubkey-b64", signed("s", raw, 7)[2]) == 1
    assert run("keystore", "unpin", "s") == 0 and run("drift", "trust", "p", file) == 0
    capsys.readouterr()
    assert run("drift", "show", "p") == 0 and out()["tools_count"] == 1
    assert run("drift", "prune", "--older-than-days", "1") == 0 and run("drift", "list") == 0 and out()["count"] == 1
    assert run("drift", "clear", "p") == 0 and run("drift", "list") == 0 and out()["count"] == 0
    assert run("policy", "show") == 0 and out()["version"] == Policy().version
    assert run("drift", "trust", "p", file.with_name("n.json")) == 1


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_against_sql(spark, tiny, duck, name):
    got = plans.QUERIES[name](spark, tiny).toPandas()
    assert len(got)
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        rows = lambda x: sorted(tuple(map(str, r)) for r in x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False))
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
