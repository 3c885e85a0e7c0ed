import pytest
from pyspark.sql import functions as F

from parlance.operators import align as A
from parlance.operators import validate as V
from parlance.schema import MESSAGES
from parlance.sources.catalog import SourceSpec, parse_info, resolve

TURNS = "array<struct<from:string,value:string>>"
SHAREGPT = SourceSpec("s", formatting="sharegpt")


def said(turns):
    return [(t["role"], t["content"]) for t in turns]


def test_alpaca_with_history(spark):
    """Earlier rounds come first, instruction and input are joined by a break, an empty input by none."""
    shape = "instruction string, input string, output string, history array<array<string>>"
    rows = [("Name a river", "in Spain", "Ebro", [["Hello", "Good day"], ["A hill?", "Teide, in fact a volcano"]]), ("Count to two", "", "1, 2", None), ("Say nothing", None, None, [])]
    got = A.align(spark.createDataFrame(rows, shape), SourceSpec("a", history="history")).collect()
    assert said(got[0]["_prompt"]) == [("user", "Hello"), ("assistant", "Good day"), ("user", "A hill?"), ("assistant", "Teide, in fact a volcano"), ("user", "Name a river\nin Spain")]
    assert said(got[0]["_response"]) == [("assistant", "Ebro")] and got[0]["_system"] == "" and got[0]["_images"] is None
    assert said(got[1]["_prompt"]) == [("user", "Count to two")] and said(got[2]["_prompt"]) == [("user", "Say nothing")] and got[2]["_response"] == []


def test_alpaca_feedback_and_media(spark):
    df = spark.createDataFrame([("q", "r", True, "x.png"), ("q", "r", False, None), ("q", "r", None, None)], "instruction string, output string, label boolean, image string")
    rows = A.align(df, SourceSpec("a", kto_tag="label", query=None, images="image")).collect()
    assert said(rows[0]["_response"]) == [("assistant", "r"), ("assistant", "")] and rows[0]["_images"] == ["x.png"]
    assert said(rows[1]["_response"]) == [("assistant", ""), ("assistant", "r")] and rows[1]["_images"] is None
    assert len(rows[2]["_response"]) == 1


def test_text_tag_is_no_feedback(spark):
    df = spark.createDataFrame([("q", "r", "true")], "instruction string, output string, label string")
    assert len(A.align(df, SourceSpec("a", kto_tag="label", query=None)).first()["_response"]) == 1


def test_sharegpt_golden(spark):
    rows = [
        [{"from": "system", "value": "sys"}, {"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}],
        [{"from": "human", "value": "q"}, {"from": "human", "value": "a"}],
        [{"from": "human", "value": "q"}],
        [],
        [{"from": "human", "value": "q"}, {"from": "stranger", "value": "a"}],
    ]
    got = A.align(spark.createDataFrame([(r,) for r in rows], f"conversations {TURNS}"), SHAREGPT).collect()
    assert said(got[0]["_prompt"]) == [("user", "q")] and said(got[0]["_response"]) == [("assistant", "a")] and got[0]["_system"] == "sys"
    assert all(g["_prompt"] == [] and g["_response"] == [] for g in got[1:])


def test_sharegpt_pairs(spark):
    df = spark.createDataFrame([([{"from": "human", "value": "q"}], {"from": "gpt", "value": "good"}, {"from": "gpt", "value": "bad"})], f"conversations {TURNS}, chosen struct<from:string,value:string>, rejected struct<from:string,value:string>")
    r = A.align(df, SourceSpec("s", formatting="sharegpt", ranking=True, chosen="chosen", rejected="rejected")).first()
    assert said(r["_prompt"]) == [("user", "q")] and said(r["_response"]) == [("assistant", "good"), ("assistant", "bad")]


def test_openai_tools(spark):
    spec = SourceSpec("o", formatting="openai", messages="messages", role_tag="role", content_tag="content", user_tag="user", assistant_tag="assistant", observation_tag="tool", function_tag="function", system_tag="system")
    call = [{"function": {"name": "f", "arguments": '{"a": "é"}'}}]
    turns = [
        {"role": "user", "content": "q", "tool_calls": None}, {"role": "assistant", "content": "", "tool_calls": call}, {"role": "tool", "content": "r1", "tool_calls": None},
        {"role": "tool", "content": "r2", "tool_calls": None}, {"role": "assistant", "content": "done", "tool_calls": []},
    ]
    df = spark.createDataFrame([(turns,), (turns[:4],)], "messages array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>")
    a, b = A.align(df, spec).collect()
    assert said(a["_prompt"]) == [("user", "q"), ("function", '[{"name": "f", "arguments": "{\\"a\\": \\"é\\"}"}]'), ("observation", "r1" + A.TOOL_JOINT + "r2")]
    assert said(a["_response"]) == [("assistant", "done")] and a["_system"] == "detailed thinking off"
    assert said(b["_response"])[0][0] == "function"  # the run at the end is dropped


def test_registries():
    reg = {"a": {"file_name": "x.json", "columns": {"prompt": "text"}}, "b": {"hf_hub_url": "h", "script_url": "s", "formatting": "sharegpt", "tags": {"role_tag": "role"}}, "c": {"cloud_file_name": "s3://b/c"}}
    a, b, c = resolve(["a", "b", "c"], reg)
    assert a.prompt == "text" and a.query is None and a.response is None and a.messages is None
    assert b.load_from == "hf_hub" and b.role_tag == "role" and b.system_tag is None and c.load_from == "cloud"
    assert resolve(["x"], "ONLINE")[0].load_from == "hf_hub" and resolve(["x"], "ONLINE", "ms_hub_url")[0].load_from == "ms_hub"  # names are those of the hub in use
    with pytest.raises(ValueError):
        resolve(["zzz"], reg)
    with pytest.raises(ValueError):
        resolve(["x"], "REMOTE:some/where")
    info = parse_info("demo:\n  path: p.jsonl\n  source: local\n  size: 10\n  weight: 0.5\n")
    assert info["demo"].size == 10 and info["demo"].weight == 0.5 and info["demo"].source == "local"
    with pytest.raises(ValueError):
        A.register_converter("alpaca", A.alpaca)


def test_stage_filters_and_marks(spark):
    m = lambda n: [{"role": "user", "content": "<image>x<image>"}] * n
    df = spark.createDataFrame([(m(1), m(1)), (m(2), m(1)), (m(1), m(2)), (m(1), [])], f"_prompt {MESSAGES}, _response {MESSAGES}")
    assert [V.stage_filter(df, s).count() for s in V.STAGES] == [1, 1, 1, 3]
    assert df.select(V.placeholders(F.col("_prompt"), "<image>").alias("n")).first()["n"] == 2
    with pytest.raises(ValueError):
        V.check_ranking("pairwise", False)


def test_v1(spark):
    df = spark.createDataFrame([("", "do", "this", "ok"), ("s", "", "", None)], "s string, i string, q string, o string")
    a, b = df.select(A.alpaca_v1(F.col("s"), F.col("i"), F.col("q"), F.col("o")).alias("m")).collect()
    assert [(x["role"], x["content"][0]["value"], x["loss_weight"]) for x in a["m"]] == [("user", "dothis", 0.0), ("assistant", "ok", 1.0)]
    assert [x["role"] for x in b["m"]] == ["system"]
    t = spark.createDataFrame([("[1]",), ("{",), (None,)], "t string").select(A.valid_tools(F.col("t")).alias("t")).collect()
    assert [x["t"] for x in t] == ["[1]", None, None]


def test_remote_registry(tmp_path):
    """The repository's own registry file is read, so local names, columns and hubs all count."""
    (tmp_path / "dataset_info.json").write_text('{"own": {"ms_hub_url": "m/x", "hf_hub_url": "h/x", "ranking": true, "columns": {"chosen": "good"}}}')
    asked = []
    fetch = lambda repository: asked.append(repository) or str(tmp_path / "dataset_info.json")
    (spec,) = resolve(["own"], "REMOTE:some/where", "ms_hub_url", fetch)
    assert asked == ["some/where"] and (spec.name, spec.load_from, spec.ranking, spec.chosen, spec.prompt) == ("m/x", "ms_hub", True, "good", None)
    with pytest.raises(ValueError):
        resolve(["other"], "REMOTE:some/where", fetch=fetch)


def test_nested_info_files():
    info = parse_info("""
# two sources
first:
  path: a/b.jsonl   # where
  source: local
  converter: 'alpaca'
  columns:
    prompt: "the # question"
    media: [image, "video"]
  filters:
    - lang: de
      least: 3
    - plain
second:
  path: hub/name
  size: 10
  weight: 1.5
  streaming: false
""")
    assert info["first"].path == "a/b.jsonl" and info["first"].converter == "alpaca" and info["second"].weight == 1.5 and info["second"].size == 10
    assert info["first"].extra == {"columns": {"prompt": "the # question", "media": ["image", "video"]}, "filters": [{"lang": "de", "least": 3}, "plain"]}
