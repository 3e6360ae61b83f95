"""A user rule pack read from JSON lines replaces the built-in one."""

import json


def test_user_pack_roundtrip(spark, tmp_path):
    from shieldline.functions.rules import RulePack
    from shieldline.operators.screen import screen_prompts
    from shieldline.sources.rules_source import read_rules
    rows = [
        {"rule_id": "u-1", "layer": "english", "grp": "exfiltration", "category": "Data Exfiltration",
         "ord": 1, "anchors": ["smuggle"], "pattern": r"smuggle\s+(the\s+)?files", "enabled": True},
        {"rule_id": "u-2", "layer": "english", "grp": "ignore", "category": "Ignore / Override Instructions",
         "ord": 2, "anchors": [], "pattern": r"never\s+matches\s+here", "enabled": False},
    ]
    path = tmp_path / "pack.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    pack = RulePack.from_df(read_rules(spark, str(path)))
    assert [r.rule_id for r in pack.rules] == ["u-1"]          # disabled rule dropped
    df = spark.createDataFrame([("1", "please smuggle the files out"), ("2", "hello")],
                               "prompt_id string, text string")
    out = {r.prompt_id: r for r in screen_prompts(df, pack, logged_at="2024-01-01 00:00:00").collect()}
    assert out["1"].matched_rule_id == "u-1" and out["1"].en_category == "Data Exfiltration"
    assert out["1"].decision == "BLOCKED" and out["2"].matched_rule_id is None
