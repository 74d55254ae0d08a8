"""Policy files, allowlists and decisions."""

from __future__ import annotations

import json

import pytest

from tidewarden.operators import policy
from tidewarden.operators.policy import Policy, decide

CALL = '{"jsonrpc":"2.0","id":7,"method":"tools/call","params":{"name":"%s","arguments":{"q":"%s"}}}'


def lines(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, direction string, program string, raw string")


def actions(df):
    return [r.action for r in df.orderBy("seq").collect()]


def test_policy_files(tmp_path, spark):
    path = tmp_path / "policy.toml"
    path.write_text('fail_mode = "open"\nscan_unicode = false\nversion = "7"\nallow_patterns = ["a"]\nother = 1\n[allow_patterns_per_tool]\nsh = ["shell_substitution"]\n')
    p = Policy.load(path)
    assert (p.fail_mode, p.scan_unicode, p.allow_patterns, p.allow_patterns_per_tool, p.scan_confusable) == ("open", False, ("a",), {"sh": ("shell_substitution",)}, True)
    assert Policy.load(tmp_path / "none") == Policy() == Policy.load(None)
    row = p.row(spark).first()
    assert row.allow_patterns_per_tool == {"sh": ["shell_substitution"]} and len(row) == 13
    base = 'fail_mode = "open"\nscan_unicode = true\nversion = "1"\n'
    for bad in ('fail_mode = "open"', base + 'tools_list_drift_detection = "x"', base + 'tools_list_hash_backend = "md5"', base.replace('"open"', '"ajar"'), base + "allow_patterns = 3", base + 'allow_servers = [1]', base.replace("true", '"yes"'), base + "allow_patterns_per_tool = 1"):
        with pytest.raises(ValueError):
            Policy.parse(bad)


def test_environment(spark):
    keys = spark.createDataFrame([("ld_preload",), ("LD_PRELOAD",), ("PATH",), ("ld_preload",), ("Node_Options",)], "key string")
    assert [r.key for r in policy.leaked_env(keys, Policy()).collect()] == ["LD_PRELOAD", "Node_Options", "ld_preload"]
    assert policy.leaked_env(keys, Policy(deny_env_keys=())).count() == 0
    assert [r.key for r in policy.leaked_env(keys, Policy(deny_env_keys=("path",))).collect()] == ["PATH"]


def test_inbound(spark):
    df = lines(spark, ("inbound", "p", CALL % ("t", "fine")), ("inbound", "p", CALL % ("t", "$(rm)")), ("inbound", "p", "  "), ("inbound", "p", "{oops"), ("inbound", "p", None), ("inbound", "/opt/p", CALL % ("sh", "$(rm)")), ("outbound", "p", "$(rm)"), ("outbound", "p", ""))
    assert actions(decide(df, Policy())) == ["forward", "block", "drop", "forward_unparsed", "drop", "block", "forward", "forward"]
    assert actions(decide(df, Policy(fail_mode="open")))[1] == "warn"
    assert actions(decide(df, Policy(allow_patterns=("shell_substitution",))))[1] == "forward"
    assert actions(decide(df, Policy(allow_patterns_per_tool={"sh": ("shell_substitution",)})))[5] == "forward"
    assert actions(decide(df, Policy(allow_patterns_per_tool={"sh": ("javascript_uri",)})))[5] == "block"
    assert actions(decide(df, Policy(allow_servers=("p",)))) == ["forward_trusted", "forward_trusted", "drop", "forward_unparsed", "drop", "forward_trusted", "forward_trusted", "forward_trusted"]
    rows = decide(df, Policy()).orderBy("seq").collect()
    assert json.loads(rows[1].reply) == {"jsonrpc": "2.0", "id": 7, "error": {"code": -32603, "message": "blocked by tidewarden", "data": {"matched_patterns": ["shell_substitution"], "cve_refs": ["CVE-2026-27124"]}}}
    assert [r.recorded for r in rows] == [False, True, False, False, False, True, True, False]
    assert all(r.reply is None for r in rows if r.action != "block")


def test_outbound_ignores_the_tool_list(spark):
    df = lines(spark, ("outbound", "p", "$(x)"))
    assert decide(df, Policy(allow_patterns_per_tool={"sh": ("shell_substitution",)})).first().recorded
    assert not decide(df, Policy(allow_patterns=("shell_substitution",))).first().recorded


BASE = "program string, tools array<struct<name:string,description_hash:string,param_names:array<string>,required_set_hash:string>>"


def baseline(spark):
    return spark.createDataFrame([("p", [("read_file", "", [], ""), ("send_message", "", [], "")])], BASE)


def test_collisions_and_gate(spark):
    base = baseline(spark)
    df = lines(spark, ("inbound", "p", CALL % ("send_message", "x")), ("inbound", "p", CALL % ("ѕend_message", "x")), ("inbound", "p", CALL % ("Send_Message", "x")), ("inbound", "q", CALL % ("ѕend_message", "x")), ("inbound", "p", CALL % ("new_tool", "x")), ("inbound", "p", '{"id":"a","method":"tools/list"}'))
    out = decide(df, Policy(), base).orderBy("seq").collect()
    assert [r.collision for r in out] == [None, "send_message", "send_message", None, None, None]
    assert out[1].matched_patterns == ["tool_name_collision"] and out[1].cve_refs == ["CVE-2026-29774"] and out[1].action == "block"
    # neither an allowed pattern nor switched off scanning lets it pass; a trusted server and no drift detection do
    assert actions(decide(df, Policy(allow_patterns=("tool_name_collision",)), base))[1] == "block"
    assert actions(decide(df, Policy(allow_servers=("p",)), base))[1] == "forward_trusted"
    assert actions(decide(df, Policy(tools_list_drift_detection="off"), base))[1] == "forward"
    strict = Policy(tools_list_drift_detection="block", tools_list_drift_inbound_check=True)
    refused = decide(df, strict, base).orderBy("seq").collect()[5]
    assert refused.action == "refuse" and json.loads(refused.reply)["error"]["code"] == -32001 and json.loads(refused.reply)["id"] == "a"
    assert actions(decide(df, Policy(tools_list_drift_detection="block"), base))[5] == "forward"


def test_drift_is_enforced(spark):
    from tests.test_manifests import listed, tools
    from tidewarden.sources.store import BASELINES

    note = '{"method":"notifications/tools/list_changed"}'
    df = lines(spark, ("outbound", "p", listed(tools("a"))), ("outbound", "p", listed(tools("a", "b"))), ("outbound", "p", note), ("inbound", "p", listed(tools("z"))), ("outbound", "p", '{"result":{"tools":[{}]}}'), ("outbound", "p", listed(tools("a")))).selectExpr("*", "concat('t', seq) AS ts_iso")
    none = spark.createDataFrame([], BASELINES)
    out, after = policy.enforce(df, Policy(tools_list_drift_detection="block", inject_fingerprint_meta=True), none)
    rows = out.orderBy("seq").collect()
    assert [r.drift for r in rows] == ["unknown", "drift", None, None, "error", "match"]
    assert [r.action for r in rows] == ["forward", "replace", "forward", "forward", "forward", "forward"]
    assert rows[2].kind == "tools_changed"
    error = json.loads(rows[1].reply)["error"]
    assert error["code"] == -32001 and error["data"]["drift"]["added"] == ["b"] and error["data"]["program"] == "p"
    meta = json.loads(rows[0].stamped)["result"]["_meta"]["tidewarden/fingerprint"]
    assert meta["hash_backend"] == "blake3" and meta["baseline_iso"] == "t0" and rows[1].stamped is None
    assert after.first().last_seen_iso == "t5"
    out, _ = policy.enforce(df, Policy(), none)
    assert {r.action for r in out.collect()} == {"forward"}
    out, same = policy.enforce(df, Policy(tools_list_drift_detection="off", inject_fingerprint_meta=True), none)
    assert {r.drift for r in out.collect()} == {None} and same.count() == 0
