import pytest
from pyspark.sql import functions as F

from parlance.functions import templates as T
from parlance.schema import MESSAGES

TALK = [("user", "How are you"), ("assistant", "I am fine!"), ("user", "你好"), ("assistant", "很高兴认识你！")]


def frame(spark, turns=TALK, system=""):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns], system)], f"m {MESSAGES}, s string")


def one(spark, template, turns=TALK, system="", **kw):
    r = frame(spark, turns, system).select(T.one_turn(template, F.col("m"), F.col("s"), **kw).alias("t")).first()["t"]
    return r["prompt"], r["response"]


def test_registry_has_every_format():
    assert len(T.REGISTRY) == 120
    for name in ("default", "llama2", "qwen3_6", "aeva", "openchat-3.6"):
        assert name in T.REGISTRY


def test_plain(spark):
    prompt, response = one(spark, T.REGISTRY["llama3"])
    turn = "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>"
    assert prompt == "<s>" + turn.format("user", "How are you") + "<|start_header_id|>assistant<|end_header_id|>\n\nI am fine!<|eot_id|>" + turn.format("user", "你好") + "<|start_header_id|>assistant<|end_header_id|>\n\n"
    assert response == "很高兴认识你！<|eot_id|>"


def test_system_in_first_user_turn(spark):
    prompt, _ = one(spark, T.REGISTRY["llama2"], TALK[:2], "Be kind.")
    assert prompt == "<s>[INST] <<SYS>>\nBe kind.\n<</SYS>>\n\nHow are you [/INST]"


def test_default_system_and_empty_system(spark):
    assert "You are Qwen, created by Alibaba Cloud." in one(spark, T.REGISTRY["qwen"], TALK[:2])[0]
    assert one(spark, T.REGISTRY["chatml"], TALK[:2])[0] == "<|im_start|>user\nHow are you<|im_end|>\n<|im_start|>assistant\n"


def test_only_first_placeholder_is_replaced(spark):
    prompt, _ = one(spark, T.REGISTRY["empty"], [("user", "{{content}} x {{content}}"), ("assistant", "y")])
    assert prompt == "{{content}} x {{content}}"


EMPTY = "<think>\n\n</think>\n\n"


@pytest.mark.parametrize("thinking", [True, False, None])
@pytest.mark.parametrize("cot", [True, False])
def test_reasoning_matrix(spark, thinking, cot):
    answer = ("<think>\nbecause\n</think>\n\n" if cot else "") + "fine"
    turns = [("user", "a"), ("assistant", "<think>\nold\n</think>\n\nb"), ("user", "c"), ("assistant", answer)]
    prompt, response = one(spark, T.REGISTRY["qwen3"], turns, thinking=thinking)
    assert "old" not in prompt and "b<|im_end|>" in prompt
    ends_empty = prompt.endswith(EMPTY)
    if cot and thinking is not False:
        assert "because" in response and not ends_empty
    elif thinking:
        assert response == EMPTY + "fine<|im_end|>\n" and not ends_empty
    else:
        assert response == "fine<|im_end|>\n" and ends_empty


def test_multi_turn_discards_history(spark):
    turns = [("user", "a"), ("assistant", "<think>\nold\n</think>\n\nb"), ("user", "c"), ("assistant", "d")]
    col = T.multi_turn(T.REGISTRY["qwen3"], F.col("m"), F.col("s"), discard_history=True)
    pairs = frame(spark, turns).select(col.alias("p")).first()["p"]
    assert [p["response"] for p in pairs] == ["b<|im_end|>\n", EMPTY + "d<|im_end|>\n"]
    kept = frame(spark, turns).select(T.multi_turn(T.REGISTRY["qwen3"], F.col("m"), F.col("s")).alias("p")).first()["p"]
    assert "old" in kept[0]["response"]


def test_closing_thought_only(spark):
    prompt, response = one(spark, T.REGISTRY["glm4_7"], TALK[:2], thinking=False)
    assert prompt == "[gMASK]<sop><|user|>\nHow are you<|assistant|></think>"
    assert response == "\nI am fine!"


def test_unknown_role_fails(spark):
    with pytest.raises(Exception, match="unexpected role"):
        one(spark, T.REGISTRY["chatml"], [("user", "a"), ("nobody", "b")])


def test_resolve_and_tokens():
    with pytest.raises(ValueError):
        T.resolve("no such")
    with pytest.raises(ValueError):
        T.resolve("falcon", train_on_prompt=True)
    assert T.resolve("qwen", default_system="x").default_system == "x" and T.REGISTRY["qwen"].default_system != "x"
    assert T.special_tokens(T.REGISTRY["llama3"], "</s>", None) == {"eos": "<|eot_id|>", "pad": "<|eot_id|>", "additional": ["<|eom_id|>"]}
    assert T.stop_words(T.REGISTRY["chatml"], "<|im_end|>") == ["<|im_end|>", "<|im_start|>"]
    with pytest.raises(ValueError):
        T.register("qwen", T.REGISTRY["qwen"])


def test_exports():
    assert "<<SYS>>" in T.to_jinja(T.REGISTRY["llama2"]) and "{% for message in loop_messages %}" in T.to_jinja(T.REGISTRY["qwen"])
    assert 'PARAMETER stop "<|im_end|>"' in T.to_modelfile(T.REGISTRY["qwen"])


def test_infer_from_renderer():
    def render(messages, go, default="Be kind."):
        if messages[0]["role"] != "system" and default:
            messages = [{"role": "system", "content": default}, *messages]
        return "<s>" + "".join(f"[{m['role']}]{m['content']}[end]\n" for m in messages) + ("[assistant]" if go else "")

    t = T.infer(render, "<s>")
    assert t.system == ("[system]{{content}}[end]\n",) and t.user == ("[user]{{content}}[end]\n[assistant]",) and t.default_system == "Be kind." and t.prefix == ("<s>",)
    assert T.infer(lambda m, g: render(m, g, ""), "<s>").default_system == ""
