"""Registered queries of media texts, tool codecs, every chat template, and operators that the other modules leave out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import chatformat, media, metrics, rendering, templates, toolcalls
from parlance.functions.tokens import Chars
from parlance.operators import align, collate, encode, mix, requests, validate
from parlance.plans.queries import CHAT_SQL, ORDERED_SQL, aligned, chats, query, table, whole
from parlance.schema import USER, message, messages
from parlance.sources import readers
from parlance.sources.catalog import SourceSpec


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Media texts (P1-P24): metadata by document, marks of each kind a family takes.

_TOKENS = {"image": "[I]", "video": "[V]", "audio": "[A]", "length": 3, "audio_length": 4, "vision_bos": "(", "vision_eos": ")"}
_PLAIN = {k: v for k, v in _TOKENS.items() if not k.startswith("vision")}
_META_SQL = """
WITH x AS (
  SELECT doc_id, 2 + doc_id % 3 AS t, 4 AS h, 2 * (1 + doc_id % 3) AS w, 56 + 14 * (doc_id % 4) AS height, 70 AS width, 1 + doc_id % 3 AS frames, 60 + doc_id % 300 AS mel, 1 + doc_id % 5 AS soft,
         doc_id % 3 AS slices, doc_id % 4 AS crops, 0.5 * (doc_id % 4) AS begin FROM documents
)
"""


def _metas(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    d = readers.spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", (2 + i % 3).alias("t"), F.lit(4).alias("h"), (2 * (1 + i % 3)).alias("w"), (56 + 14 * (i % 4)).alias("height"), F.lit(70).alias("width"), (1 + i % 3).alias("frames"))
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        F.struct(
            "t", "h", "w", "height", "width", "frames", (60 + i % 300).alias("mel"), (1 + i % 5).alias("soft_tokens"), (1 + i % 3).alias("patches"), (i % 3).alias("rows"), F.lit(2).alias("columns"), (i % 4).alias("crops"),
            F.lit(336).alias("best_height"), F.lit(672).alias("best_width"), (1 + i % 2).alias("ratio_h"), F.lit(2).alias("ratio_w"), F.lit(1.0).alias("second_per_grid"),
            F.transform(F.sequence(F.lit(0), F.col("t").cast("int") - 1), lambda k: k + 0.5 * (i % 4)).alias("seconds"), F.transform(F.sequence(F.lit(1), F.col("t").cast("int")), lambda k: k).alias("frame_patches"),
        ).alias("m"),
    )


_REP = "repeat('{0}', CAST({1} AS INT))"
_GRID, _FRAME, _PIXELS = "(t * h * w) // 4", "(h * w) // 4", "(height // 14) * (width // 14)"
_STRIDED = "((mel - 1) // 2 + 1 - 2) // 2 + 1"
_CHUNKED = "CAST(floor((floor((floor((mel % 100 - 1) / 2.0) + 1 - 1) / 2.0) + 1 - 1) / 2.0) + 1 + floor(mel / 100.0) * 13 AS BIGINT)"


def _rep(token: str, n: str) -> str:
    return _REP.format(token, n)


def _frames_sql(each: str, joint: str = "") -> str:
    return f"array_to_string(list_transform(range(t), lambda i: {each}), '{joint}')"


def _between(start: str, middle: str, end: str) -> str:
    return f"'{start}' || {middle} || '{end}'"


_NL = "chr(10)"
_SLICES = f"CASE WHEN slices > 0 THEN array_to_string(list_transform(range(slices), lambda i: repeat('<slice>' || {_rep('<unk>', '64')} || '</slice>', 2)), {_NL}) ELSE '' END"
_GEMMA = "chr(10) || chr(10) || '<start_of_image>[I][I][I]<end_of_image>' || chr(10) || chr(10)"
_NEXT = "(CASE WHEN 70.0 / height > 48.0 / 24 THEN 24 - 2 * ((24 - height * 48 // 70) // 2) ELSE 24 END) * (CASE WHEN 70.0 / height > 48.0 / 24 THEN 48 ELSE 48 - 2 * ((48 - 70 * 24 // height) // 2) END) + (CASE WHEN 70.0 / height > 48.0 / 24 THEN 24 - 2 * ((24 - height * 48 // 70) // 2) ELSE 24 END) + 576"
_TILE = _rep("<|patch|>", "(height // 14) * (width // 14) // 4")
#: case -> (family, tokens, kind -> SQL of the first and second mark's text)
_MEDIA: dict[str, tuple[str, dict, dict[str, str]]] = {
    "base": ("base", _TOKENS, {"image": "'<image>'", "video": "'<video>'", "audio": "'<audio>'"}),
    "ernie_vl": ("ernie_vl", _TOKENS, {"image": "'Picture {n}:<|IMAGE_START|>' || " + _rep("[I]", _GRID) + " || '<|IMAGE_END|>'", "video": "'Video {n}:<|VIDEO_START|>' || " + _rep("[V]", _GRID) + " || '<|VIDEO_END|>'"}),
    "gemma3": ("gemma3", _TOKENS, {"image": _GEMMA}),
    "gemma3_crops": ("gemma3", _TOKENS | {"pan_and_scan": True}, {"image": f"'Here is the original image ' || {_GEMMA} || ' and here are some crops to help you see better ' || array_to_string(list_transform(range(crops), lambda i: {_GEMMA}), ' ')"}),
    "gemma3n": ("gemma3n", _TOKENS, {"image": _GEMMA, "audio": "chr(10) || chr(10) || '<start_of_audio>[A][A][A][A]<end_of_audio>' || chr(10) || chr(10)"}),
    "gemma4": ("gemma4", _TOKENS, {
        "image": _between("<|image>", _rep("[I]", "soft"), "<image|>"), "audio": _between("<|audio>", _rep("[A]", "soft"), "<audio|>"),
        "video": _frames_sql("printf('%02d:%02d', CAST(floor(i + begin) AS INT) // 60, CAST(floor(i + begin) AS INT) % 60) || ' <|image>' || " + _rep("[V]", "soft") + " || '<image|>'", " "),
    }),
    "intern_vl": ("intern_vl", _TOKENS, {"image": _between("<img>", _rep("<IMG_CONTEXT>", "3 * (1 + doc_id % 3)"), "</img>"), "video": f"array_to_string(list_transform(range(t), lambda i: 'Frame' || (i + 1) || ': <img>' || {_rep('<IMG_CONTEXT>', '3 * (i + 1)')} || '</img>'), {_NL})"}),
    "kimi_vl": ("kimi_vl", _TOKENS, {"image": _between("<|media_start|>image<|media_content|>", _rep("[I]", _FRAME), "<|media_end|>")}),
    "llama4": ("llama4", _TOKENS, {"image": f"'<|image_start|>' || repeat({_TILE} || '<|tile_x_separator|>' || {_TILE} || '<|tile_y_separator|>', CAST(1 + doc_id % 2 AS INT)) || '<|image|>' || {_TILE} || '<|image_end|>'"}),
    "llava": ("llava", _TOKENS, {"image": _rep("[I]", _PIXELS)}),
    "llava_next": ("llava_next", _TOKENS, {"image": _rep("[I]", _NEXT)}),
    "llava_next_video": ("llava_next_video", _TOKENS, {"image": _rep("[I]", _NEXT), "video": _rep("[V]", f"{_PIXELS} // 4 * frames")}),
    "minicpm_v": ("minicpm_v", _TOKENS, {"image": f"'<image_id>' || ({{n}} - 1) || '</image_id><image>' || {_rep('<unk>', '64')} || '</image>' || {_SLICES}", "audio": _between("<|audio_start|>", _rep("<unk>", "soft"), "<|audio_end|>")}),
    "minicpm_v_video": ("minicpm_v", _TOKENS, {"video": f"repeat('<image>' || {_rep('<unk>', '64')} || '</image>' || {_SLICES}, CAST(frames AS INT))"}),
    "mllama": ("mllama", _TOKENS, {"image": "'[I]'"}),
    "paligemma": ("paligemma", _TOKENS, {"image": "''"}),
    "pixtral": ("pixtral", _TOKENS, {"image": f"repeat({_rep('[I]', 'width // 16')} || '[IMG_BREAK]', CAST(height // 16 - 1 AS INT)) || {_rep('[I]', 'width // 16')} || '[IMG_END]'"}),
    "qwen2_audio": ("qwen2_audio", _TOKENS, {"audio": _between("<|audio_bos|>", _rep("[A]", _STRIDED), "<|audio_eos|>")}),
    "qwen2_vl": ("qwen2_vl", _TOKENS, {"image": _between("(", _rep("[I]", _GRID), ")"), "video": _between("(", _rep("[V]", _GRID), ")")}),
    "qwen3_vl": ("qwen3_vl", _PLAIN, {"image": _between("<|vision_start|>", _rep("[I]", _GRID), "<|vision_end|>"), "video": _frames_sql("printf('<%.1f seconds>', CAST(i + begin AS DOUBLE)) || '<|vision_start|>' || " + _rep("[V]", _FRAME) + " || '<|vision_end|>'")}),
    "glm4v": ("glm4v", _TOKENS, {"image": _between("<|begin_of_image|>", _rep("[I]", _GRID), "<|end_of_image|>"), "video": "'<|begin_of_video|>' || " + _frames_sql("'<|begin_of_image|>' || " + _rep("[I]", _FRAME) + " || '<|end_of_image|>' || CAST(floor(i + begin) AS BIGINT)") + " || '<|end_of_video|>'"}),
    "qwen2_omni": ("qwen2_omni", _PLAIN, {"image": _between("<|vision_bos|>", _rep("[I]", _GRID), "<|vision_eos|>"), "video": _between("<|vision_bos|>", _rep("[V]", _GRID), "<|vision_eos|>"), "audio": _between("<|audio_bos|>", _rep("[A]", _STRIDED), "<|audio_eos|>")}),
    "qwen3_omni": ("qwen3_omni", _PLAIN, {"image": _between("<|vision_bos|>", _rep("[I]", _GRID), "<|vision_eos|>"), "video": _between("<|vision_bos|>", _rep("[V]", _GRID), "<|vision_eos|>"), "audio": _between("<|audio_bos|>", _rep("[A]", _CHUNKED), "<|audio_eos|>")}),
    "video_llava": ("video_llava", _TOKENS, {"image": _rep("[I]", _PIXELS), "video": _rep("[V]", f"({_PIXELS} + 1) * frames")}),
    "lfm2_vl": ("lfm2_vl", _TOKENS, {"image": _rep("[I]", "(h * w) // 4")}),
    "youtu_vl": ("youtu_vl", _PLAIN, {"image": "'<|vision_start|>[I]<|vision_end|>'", "video": "'<|vision_start|>[V]<|vision_end|>'"}),
}


def _media_sql() -> str:
    rows = []
    for case, (_, _, kinds) in _MEDIA.items():
        parts = [f"'{kind} ' || {sql.replace('{n}', '1')} || ' then ' || {sql.replace('{n}', '2')} || '; '" for kind, sql in kinds.items()]
        rows.append(f"SELECT doc_id, '{case}' AS family, md5({' || '.join(parts)}) AS text FROM x")
    return _META_SQL + " UNION ALL ".join(rows)


@query(_media_sql())
def media_texts(spark, sf_dir):
    """Two marks of each kind of media that a family takes, expanded from metadata."""
    d = _metas(spark, sf_dir)
    both, out = F.array("m", "m"), []
    for case, (family, tokens, kinds) in _MEDIA.items():
        text = "".join(f"{kind} {media.MARKS[kind]} then {media.MARKS[kind]}; " for kind in kinds)
        made = media.expand_media(messages(message(USER, F.lit(text))), family, tokens, **{f"{kind}s": both for kind in kinds})
        out.append(F.struct(F.lit(case).alias("family"), F.md5(made[0]["content"]).alias("text")))
    return d.select("doc_id", F.explode(F.array(*out)).alias("x")).select("doc_id", "x.*")


@query(_META_SQL + f"""SELECT doc_id, 'see <|vision_bos|><|audio_bos|>' || array_to_string(list_transform(range(greatest((t + 1) // 2, ({_STRIDED} + 49) // 50)),
  lambda j: repeat('[V]', CAST({_FRAME} * least(2, greatest(0, t - 2 * j)) AS INT)) || repeat('[A]', CAST(least(50, greatest(0, {_STRIDED} - 50 * j)) AS INT))), '') || '<|audio_eos|><|vision_eos|> end' AS text FROM x""")
def sound_in_video(spark, sf_dir):
    """A video's tokens and its sound's, dealt by chunks of two seconds (P20)."""
    made = media.expand_media(messages(message(USER, F.lit("see <video><audio> end"))), "qwen2_omni", _PLAIN, videos=F.array("m"), audios=F.array("m"), sound_in_video=True)
    return _metas(spark, sf_dir).select("doc_id", made[0]["content"].alias("text"))


@query("""
WITH x AS (SELECT doc_id, doc_id % 4 AS a, doc_id % 3 AS b FROM documents)
SELECT doc_id, CAST(a + 3 + b + 2 AS INT) AS n, CAST(2 * 2 + (b + 3) * 1 AS INT) AS seen FROM x
""")
def cross_attention(spark, sf_dir):
    """Which tiles of which image each position sees: the first image's two up to the second image, the second's one from there on."""
    word, image = lambda n: F.array_repeat(F.lit(7), n.cast("int")), F.array(F.lit(9))
    ids = F.concat(word(F.col("doc_id") % 4), image, word(F.lit(1)), image, word(F.col("doc_id") % 3 + 2))
    mask = media.cross_attention_mask(ids, 9, F.array(F.lit(2), F.lit(1)), 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids).alias("n"), F.aggregate(F.flatten(F.flatten(mask)), F.lit(0), lambda a, x: a + x).alias("seen"))


# Tool codecs (U1-U13, T3, T4): prompt, written turn, and the call read back.

_NAME, _TEXT, _COUNT = "@@NAME@@", "@@TEXT@@", "@@COUNT@@"
_TOOL = {"name": _NAME, "description": "Looks up", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what"}, "n": {"type": "integer", "description": "how many"}}, "required": ["q"]}}
_ARGS = f'{{"q": "{_TEXT}", "n": {_COUNT}}}'
_BARE, _WRAPPED = json.dumps(_TOOL), json.dumps({"type": "function", "function": _TOOL})
_DATE = "02 Mar 2024"
_QWEN_TURN = f'<tool_call>\n{{"name": "{_NAME}", "arguments": {_ARGS}}}\n</tool_call>'
_TAGGED = lambda head, one, tail: head + one.format("q", _TEXT) + one.format("n", _COUNT) + tail
#: codec -> (prompt, written turn, arguments as read, None where the written turn isn't a call by itself)
_CODECS: dict[str, tuple[str, str, str | None]] = {
    "default": (toolcalls.DEFAULT_PROMPT.format(tools=f"> Tool Name: {_NAME}\nTool Description: Looks up\nTool Args:\n  - q (string, required): what\n  - n (integer): how many\n\n", names=_NAME), f"Action: {_NAME}\nAction Input: {_ARGS}", _ARGS),
    "gemma4": (
        f'declaration:{_NAME}{{description:<|"|>Looks up<|"|>,parameters:{{properties:{{q:{{description:<|"|>what<|"|>,type:<|"|>STRING<|"|>}},n:{{description:<|"|>how many<|"|>,type:<|"|>INTEGER<|"|>}}}},required:[<|"|>q<|"|>],type:<|"|>OBJECT<|"|>}}}}',
        f'<|tool_call>call:{_NAME}{{n:{_COUNT},q:<|"|>{_TEXT}<|"|>}}<tool_call|>', f'{{"n": {_COUNT}, "q": "{_TEXT}"}}',
    ),
    "glm4": (toolcalls.GLM4_PROMPT.format(tools=f"\n\n## {_NAME}\n\n{json.dumps(_TOOL, indent=4)}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"), f"{_NAME}\n{_ARGS}", _ARGS),
    "llama3": (toolcalls.LLAMA3_PROMPT.format(tools=json.dumps({"type": "function", "function": _TOOL}, indent=4) + "\n\n", date=_DATE), f'{{"name": "{_NAME}", "parameters": {_ARGS}}}', _ARGS),
    "lfm2": (toolcalls.LFM2_PROMPT.format(tools=f"[{_BARE}]"), f'<|tool_call_start|>[{_NAME}(q="{_TEXT}", n={_COUNT})]<|tool_call_end|>', _ARGS),
    "minimax1": (toolcalls.MINIMAX1_PROMPT.format(tools=_BARE + "\n"), f'<tool_calls>\n{{"name": "{_NAME}", "arguments": {_ARGS}}}\n</tool_calls>', _ARGS),
    "minimax2": (toolcalls.MINIMAX2_PROMPT.format(tools=f"<tool>{_BARE}</tool>\n"), _TAGGED(f'<invoke name="{_NAME}">', '\n<parameter name="{0}">{1}</parameter>', "\n</invoke>"), None),
    "mistral": (f"[AVAILABLE_TOOLS] [{_WRAPPED}][/AVAILABLE_TOOLS]", f'[{{"name": "{_NAME}", "arguments": {_ARGS}}}]', _ARGS),
    "qwen": (toolcalls.QWEN_PROMPT.format(tools="\n" + _WRAPPED), _QWEN_TURN, _ARGS),
    "qwen3_5": (toolcalls.QWEN35_PROMPT.format(tools="\n" + _BARE), _TAGGED(f"<tool_call>\n<function={_NAME}>", "\n<parameter={0}>\n{1}\n</parameter>", "\n</function>\n</tool_call>"), _ARGS),
    "glm4_moe": (toolcalls.GLM4_MOE_PROMPT.format(tools="\n" + _WRAPPED), _TAGGED(f"\n<tool_call>{_NAME}", "\n<arg_key>{0}</arg_key>\n<arg_value>{1}</arg_value>", ""), None),
    "seed_oss": (toolcalls.SEED_PROMPT.format(tools=f"\n[{_BARE}]"), _TAGGED(f"\n<seed:tool_call>\n<function={_NAME}", "\n<parameter={0}>{1}</parameter>", "\n</function>\n</seed:tool_call>"), _ARGS),
    "ling": (toolcalls.LING_PROMPT.format(tools="\n" + _WRAPPED) + "\ndetailed thinking off", _QWEN_TURN, _ARGS),
}


def _codec_sql() -> str:
    put = lambda text: f"replace(replace(replace({quoted(text)}, '{_NAME}', 'find_' || name), '{_TEXT}', what), '{_COUNT}', n)"
    rows = [
        f"SELECT doc_id, '{c}' AS codec, md5({put(prompt)}) AS prompt, {put(turn)} AS turn, {'NULL' if given is None else chr(39) + 'find_' + chr(39) + ' || name'} AS name, {'NULL' if given is None else put(given)} AS arguments FROM x"
        for c, (prompt, turn, given) in _CODECS.items()
    ]
    return "WITH x AS (SELECT doc_id, coalesce(lang, 'any') AS name, 'Überall ' || coalesce(source, '') AS what, CAST(n_chars AS VARCHAR) AS n FROM documents) " + " UNION ALL ".join(rows)


@query(_codec_sql())
def tool_codecs(spark, sf_dir):
    """Tool prompt, written call and the call read back, in each of the 13 formats."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("any")).alias("name"), F.concat(F.lit("Überall "), F.coalesce("source", F.lit(""))).alias("what"), F.col("n_chars").cast("string").alias("n"))
    put = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit(_NAME), F.concat(F.lit("find_"), "name")), F.lit(_TEXT), F.col("what")), F.lit(_COUNT), F.col("n"))
    d = d.select("doc_id", put(f"[{_BARE}]").alias("tools"), put(f'{{"name": "{_NAME}", "arguments": {_ARGS}}}').alias("call"))
    out = None
    for codec in _CODECS:
        t = templates.Template(tool_format=codec, function_format=codec, kind="llama2")
        rows = toolcalls.with_prompt(d.withColumn("m", messages(message("function", F.col("call")))), t, "tools", "prompt", _DATE)
        rows = toolcalls.render_turns(rows, t, "m").withColumn("turn", F.col("m")[0]["content"])
        read = rows.select("doc_id", F.lit(codec).alias("codec"), F.md5("prompt").alias("prompt"), "turn", toolcalls.extract(codec, F.col("turn")).alias("x"))
        part = read.select("doc_id", "codec", "prompt", "turn", F.get("x.calls", F.lit(0))["name"].alias("name"), F.get("x.calls", F.lit(0))["arguments"].alias("arguments"))
        out = part if out is None else out.unionByName(part)
    return out


# Every chat template (T1-T19), over all valid dialogues.


def _slots_sql(slots: tuple, content: str) -> str:
    """Slots as one SQL text; the first placeholder of each slot is the content."""
    parts = []
    for slot in slots:
        text = templates._text(slot, "<s>", "</s>")
        before, found, after = text.partition(templates.CONTENT)
        parts += [quoted(before)] + ([content, quoted(after)] if found else [])
    return "(" + (" || ".join(parts) or "''") + ")"


def _template_sql(name: str) -> str:
    t = templates.REGISTRY[name]
    system = f"coalesce(nullif(system, ''), {quoted(t.default_system)})"
    block = f"CASE WHEN {system} = '' THEN '' ELSE {_slots_sql(t.slots('system'), system)} END"
    prefix = _slots_sql(t.slots("prefix"), "''")
    if t.kind == "llama2":
        head, user = f"CASE WHEN i = 0 THEN {prefix} ELSE '' END", _slots_sql(t.slots("user"), f"(CASE WHEN i = 0 THEN {block} ELSE '' END || text)")
    else:
        head, user = f"CASE WHEN i = 0 THEN {prefix} || {block} ELSE '' END", _slots_sql(t.slots("user"), "text")
    turn = f"{head} || CASE WHEN role = 'user' THEN {user} ELSE {_slots_sql(t.slots('assistant'), 'text')} END"
    empty = quoted(t.empty_thought) if t.reasons else "''"
    return f"SELECT conv_id, '{name}' AS template, md5(string_agg({turn}, '' ORDER BY i) FILTER (WHERE i < n - 1)) AS prompt, md5({empty} || max({turn}) FILTER (WHERE i = n - 1)) AS response FROM r GROUP BY conv_id"


def _all_templates(names: list[str]):
    def run(spark, sf_dir):
        rows = validate.stage_filter(aligned(spark, sf_dir), "supervised").select("conv_id", F.concat("_prompt", "_response").alias("m"), "_system")
        one = lambda name: F.struct(F.lit(name).alias("template"), templates.one_turn(templates.REGISTRY[name], F.col("m"), F.col("_system")).alias("t"))
        out = None
        for at in range(0, len(names), 10):
            part = rows.select("conv_id", F.explode(F.array(*[one(x) for x in names[at : at + 10]])).alias("x")).select("conv_id", "x.template", F.md5("x.t.prompt").alias("prompt"), F.md5("x.t.response").alias("response"))
            out = part if out is None else out.unionByName(part)
        return out

    return run


_GROUPS = {"plain": [], "first_turn_system": [], "reasoning": []}
for _name in sorted(templates.REGISTRY):
    _GROUPS["first_turn_system" if templates.REGISTRY[_name].kind == "llama2" else "reasoning" if templates.REGISTRY[_name].reasons else "plain"].append(_name)
for _group, _names in _GROUPS.items():
    _run = _all_templates(_names)
    _run.__name__ = f"templates_{_group}"
    _run.__doc__ = f"All dialogues in each of the {len(_names)} {_group} templates (T1-T19)."
    query(CHAT_SQL + ", r AS (SELECT m.*, ok.system FROM m JOIN ok USING (conv_id) WHERE good AND ok.n > 0) " + " UNION ALL ".join(map(_template_sql, _names)))(_run)


@query(CHAT_SQL + """SELECT a.conv_id, CAST(a.i // 2 AS INT) AS pair,
  CASE WHEN a.i = 0 AND system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || a.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
  '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || b.text || '<|im_end|>' || chr(10) AS response
FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.i = a.i + 1 JOIN ok ON ok.conv_id = a.conv_id WHERE good AND a.i % 2 = 0""")
def reasoning_pairs(spark, sf_dir):
    """Dialogues as pairs of a reasoning format, each answer with the empty thought."""
    rows = validate.stage_filter(aligned(spark, sf_dir), "supervised").withColumn("m", F.concat("_prompt", "_response"))
    pairs = templates.multi_turn(templates.REGISTRY["qwen3"], F.col("m"), F.col("_system"))
    return rows.select("conv_id", F.posexplode(pairs).alias("pair", "p")).select("conv_id", "pair", "p.prompt", "p.response")


@query("SELECT conv_id, turn, ltrim(regexp_replace('<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || chr(10) || role, '<think>\\n(.*?)\\n</think>\\n\\n', '', 'gs'), chr(10)) AS bare FROM conversations")
def answers_without_thought(spark, sf_dir):
    """Thought blocks of whole texts removed."""
    c = F.concat(F.lit("<think>\n"), "text", F.lit("\n</think>\n\n"), "role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.strip_thought(templates.REGISTRY["qwen3"], c).alias("bare"))


_V1 = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


def _typed(spark, sf_dir) -> DataFrame:
    part = lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("value"))).alias("content"), F.lit(None).cast("double").alias("loss_weight"))
    return chats(spark, sf_dir).select("conv_id", F.transform("messages", part).alias("m"))


@query(f"""
WITH x AS ({_V1}), q AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'user' AND NOT (starts_with(text, '<tool_response>') AND ends_with(text, '</tool_response>'))), max(i)) AS query FROM x GROUP BY conv_id)
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND i > query AND i = n - 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10)) ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY i) AS text,
  CAST(count(*) FILTER (WHERE role = 'assistant') AS DOUBLE) AS weight FROM x JOIN q USING (conv_id) GROUP BY conv_id
""")
def render_thinking_v1(spark, sf_dir):
    """Second-generation segments of a reasoning format: the empty thought stands in answers behind the last query."""
    rows = _typed(spark, sf_dir).select("conv_id", rendering.render_thinking(F.col("m"), F.lit(None).cast("string")).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]).alias("weight"))


@query(f"""
WITH x AS (SELECT *, length(role) + length(text) + length('<|im_start|>') + length('<|im_end|>') + 2 AS len FROM ({_V1}))
SELECT conv_id, CAST(sum(len) AS INT) AS n, CAST(coalesce(sum(len) FILTER (WHERE role = 'assistant'), 0) AS INT) AS learned, CAST(coalesce(sum(len) FILTER (WHERE role = 'assistant'), 0) AS DOUBLE) AS weight, CAST(sum(len) AS INT) AS last_position FROM x GROUP BY conv_id
""")
def segment_inputs(spark, sf_dir):
    """Segments encoded apart: ids, learned labels, loss weights and positions from 1."""
    rows = _typed(spark, sf_dir).select("conv_id", rendering.segment_inputs(rendering.chatml_segments(F.col("m")), Chars().encode).alias("x"))
    return rows.select("conv_id", F.size("x.input_ids").alias("n"), collate.valid_tokens(F.col("x.labels")).alias("learned"), F.aggregate("x.loss_weights", F.lit(0.0), lambda a, w: a + w).alias("weight"), F.element_at("x.position_ids", -1).alias("last_position"))


# Alignment.


@query("SELECT doc_id, CAST(3 AS INT) AS n, coalesce(lang, '') AS first_text, coalesce(source, '') AS second_text, text AS question FROM documents")
def align_history(spark, sf_dir):
    """Earlier rounds before an instruction row's own turn (A2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("instruction"), F.lit("").alias("input"), F.lit("x").alias("output"), F.array(F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))).alias("history"))
    rows = align.align(d, SourceSpec("docs", history="history"), ("doc_id",))
    at = lambda i: F.col("_prompt")[i]["content"]
    return rows.select("doc_id", F.size("_prompt").alias("n"), at(0).alias("first_text"), at(1).alias("second_text"), at(2).alias("question"))


@query("""SELECT doc_id, 'function' AS role, '[{"name": "f", "arguments": "{\\"n\\": ' || n_chars || '}"}]' AS call, 'result ' || n_chars AS observation FROM documents""")
def align_tool_calls(spark, sf_dir):
    """Tool calls of chat messages become function turns."""
    spec = SourceSpec("o", formatting="openai", messages="messages", role_tag="role", content_tag="content", user_tag="user", assistant_tag="assistant", observation_tag="tool", function_tag="function", system_tag="system")
    none = F.lit(None).cast("array<struct<function:struct<name:string,arguments:string>>>")
    n = F.col("n_chars").cast("string")
    calls = F.array(F.struct(F.struct(F.lit("f").alias("name"), F.concat(F.lit('{"n": '), n, F.lit("}")).alias("arguments")).alias("function")))
    turn = lambda role, text, c=none: F.struct(F.lit(role).alias("role"), text.alias("content"), c.alias("tool_calls"))
    m = F.array(turn("user", F.col("text")), turn("assistant", F.lit(""), calls), turn("tool", F.concat(F.lit("result "), n)), turn("assistant", F.lit("done")))
    rows = align.align(table(spark, sf_dir, "documents").select("doc_id", m.alias("messages")), spec, ("doc_id",))
    return rows.select("doc_id", F.col("_prompt")[1]["role"].alias("role"), F.col("_prompt")[1]["content"].alias("call"), F.col("_prompt")[2]["content"].alias("observation"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents WHERE length(text) <= 500")
def within_cutoff(spark, sf_dir):
    """Rows short enough to be packed."""
    d = table(spark, sf_dir, "documents").select("doc_id", Chars().encode(F.col("text")).alias("input_ids"))
    return validate.within_cutoff(d, 500).select("doc_id", F.size("input_ids").alias("n"))


@query("SELECT '_' || lang AS _dataset_name, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IN ('de', 'es') GROUP BY lang")
def provenance(spark, sf_dir):
    """Rows of several datasets end to end, each with its dataset's name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    named = {f"_{x}": readers.with_order(d.where(F.col("lang") == x), ["doc_id"]) for x in ("de", "es")}
    return mix.concat_named(named).groupBy("_dataset_name").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def scanned_files(spark, sf_dir):
    """A file read by its extension."""
    return readers.read_files(spark, f"{sf_dir.rstrip('/')}/region.parquet").select("r_regionkey", "r_name")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS subject, n_name AS name, CAST(n_regionkey AS VARCHAR) AS category, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def subject_categories(spark, sf_dir):
    """Questions with their subject's name and category from a mapping of one struct per subject."""
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # the mapping file: one entry a subject
    mapping = spark.range(1).select(*[F.struct(F.lit(name).alias("name"), F.lit(str(region)).alias("category")).alias(str(key)) for key, name, region in rows])
    asks = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("subject")).agg(F.count("*").alias("n"))
    return asks.join(readers.subjects(mapping), "subject").select("subject", "name", "category", "n")


# Encoding and collation.


@query("SELECT doc_id, CAST(least(length(text) + 1, 300) AS INT) AS n, md5(substr(text, 1, 299)) AS kept FROM documents")
def pretrain_rows(spark, sf_dir):
    """Texts with a begin mark, cut."""
    d = table(spark, sf_dir, "documents").select("doc_id", encode.pretrain(Chars().encode(F.col("text")), 300, Chars.bos).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n"), F.md5(Chars().decode(F.col("ids"))).alias("kept"))


def _budget_sql(source: str, target: str, cutoff: int) -> tuple[str, str]:
    t = f"least(CASE WHEN {target} * 2 < {cutoff} THEN {cutoff} WHEN {source} * 2 < {cutoff} THEN {cutoff} - {source} ELSE CAST(floor({cutoff} * ({target}::DOUBLE / ({source} + {target}))) AS BIGINT) END, {target})"
    return f"least(greatest({cutoff} - {t}, 0), {source})", t


_IN, _OUT = _budget_sql("s", "a", 200)
_IN2, _OUT2 = _budget_sql("s", "b", 200)


@query(f"WITH x AS (SELECT doc_id, 60 + doc_id % 90 AS s, length(text) AS a, doc_id % 150 AS b FROM documents) SELECT doc_id, CAST({_IN} + {_OUT} AS INT) AS n, CAST({_OUT} AS INT) AS learned, CAST({_IN2} + {_OUT2} AS INT) AS kl_n, CAST({_OUT2} AS INT) AS kl_learned FROM x")
def feedback_rows(spark, sf_dir):
    """A row's own answer and its neighbour's under one cutoff."""
    rep = lambda n: F.array_repeat(F.lit(5), n.cast("int"))
    x = encode.feedback(rep(60 + F.col("doc_id") % 90), Chars().encode(F.col("text")), rep(F.col("doc_id") % 150), 200)
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", *[c for k, name in (("", ""), ("kl_", "kl_")) for c in (F.size(f"x.{k}input_ids").alias(f"{name}n"), collate.valid_tokens(F.col(f"x.{k}labels")).alias(f"{name}learned"))])


_IN3, _OUT3 = _budget_sql("s", "(a + 1)", 150)


@query(f"WITH x AS (SELECT doc_id, length(text) AS s, doc_id % 120 AS a, text FROM documents) SELECT doc_id, md5(substr(text, 1, CAST({_IN3} AS BIGINT))) AS prompt, CAST({_OUT3} AS INT) AS target FROM x")
def unsupervised_rows(spark, sf_dir):
    """Prompt and answer apart, of different lengths."""
    x = encode.unsupervised(Chars().encode(F.col("text")), F.array_repeat(F.lit(5), (F.col("doc_id") % 120).cast("int")), 150, Chars.eos)
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", F.md5(Chars().decode(F.col("x.input_ids"))).alias("prompt"), F.size("x.labels").alias("target"))


@query("SELECT doc_id, CAST(20 AS INT) AS n, CAST(doc_id % 6 + 3 AS INT) AS pali, CAST(doc_id % 6 AS INT) AS gemma FROM documents")
def token_types(spark, sf_dir):
    """Token types and their padding."""
    images = (F.col("doc_id") % 6).cast("int")
    ids = F.concat(F.array_repeat(F.lit(7), 4), F.array_repeat(F.lit(9), images), F.array_repeat(F.lit(7), 3))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    pali, gemma = (collate.token_type_padding(media.token_types(ids, 9, kind, F.lit(4)), F.lit(20)) for kind in ("paligemma", "gemma"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pali).alias("n"), total(pali).alias("pali"), total(gemma).alias("gemma"))


@query(ORDERED_SQL + """, x AS (SELECT doc_id, o // 6 AS b, 1 + doc_id % 9 AS n, 1 + doc_id % 4 AS k FROM d)
SELECT doc_id, CAST(b AS BIGINT) AS batch_id, CAST(ceil(max(n) OVER (PARTITION BY b) / 4.0) * 4 AS INT) AS width, CAST(ceil(max(k) OVER (PARTITION BY b) / 4.0) * 4 AS INT) AS kl_width FROM x""")
def feedback_batches(spark, sf_dir):
    """Own and neighbour rows of a batch, padded apart."""
    rep = lambda n: F.array_repeat(F.lit(1), n.cast("int"))
    d = whole(spark, sf_dir).withColumn("a", rep(1 + F.col("doc_id") % 9)).withColumn("k", rep(1 + F.col("doc_id") % 4))
    rows = d.select("_ord", *[F.col("a").alias(c) for c in collate.PADDING], *[F.col("k").alias(f"kl_{c}") for c in collate.PADDING], (F.col("doc_id") % 2 == 0).alias("kto_tags"))
    own, other = collate.stack_feedback(rows, 6, 4)
    own = own.select("_ord", "batch_id", F.size("input_ids").alias("width"))
    return own.join(other.select("_ord", F.size("labels").alias("kl_width")), "_ord").join(d.select("_ord", "doc_id"), "_ord").select("doc_id", "batch_id", "width", "kl_width")


@query(ORDERED_SQL + " SELECT doc_id, CAST(o // 24 AS BIGINT) AS slice FROM d")
def fixed_slices(spark, sf_dir):
    """Rows in slices of a fixed number, the last one short."""
    return collate.fixed_slices(whole(spark, sf_dir), 24).select("doc_id", "slice")


@query(ORDERED_SQL + " SELECT doc_id, CAST((o - 7) // 10 AS BIGINT) AS step FROM d WHERE o >= 7 AND o < 7 + (n - 7) // 10 * 10")
def resumed_batches(spark, sf_dir):
    """Batches from a saved state on: rows that were consumed are skipped, those left in the buffer come first."""
    state = {"consumed": 10, "buffered": [7, 8, 9]}
    return collate.resume(whole(spark, sf_dir), state, 10).select("doc_id", "step")


# Metrics and generation.


@query("SELECT event_type, round(exp(avg(abs(value)) / 50), 9) AS ppl FROM events GROUP BY event_type")
def corpus_perplexities(spark, sf_dir):
    """exp of a class's mean loss."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg(F.abs("value")) / 50).alias("loss"))
    return e.select("event_type", F.round(metrics.corpus_perplexity(F.col("loss")), 9).alias("ppl"))


@query("""
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i, label FROM embeddings), n AS (SELECT vec_id, ln(sum(exp(v))) - max(v) FILTER (WHERE i = 1) AS nll, 1 / (1 + exp(-max(v) FILTER (WHERE i = 2))) AS p, max(label) % 2 AS y FROM t GROUP BY vec_id)
SELECT round(avg(CASE WHEN y = 1 THEN -0.25 * greatest(1 - p, 1e-6) ** 2 * ln(greatest(p, 1e-12)) ELSE -0.75 * greatest(p, 1e-6) ** 2 * ln(greatest(1 - p, 1e-12)) END) + 0.1 * avg(nll), 9) AS loss FROM n
""")
def regularised_loss(spark, sf_dir):
    """Class loss with a share of the tokens' cross-entropy."""
    z = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(metrics.focal_loss(1 / (1 + F.exp(-z[1])), F.pmod("label", F.lit(2))).alias("focal"), metrics.nll(z, F.lit(0)).alias("nll"))
    return e.agg(F.round(metrics.regularised(F.avg("focal"), F.avg("nll"), 0.1), 9).alias("loss"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'file not found' END AS error, CASE WHEN page_id % 5 = 0 THEN -1.0 END::DOUBLE AS p FROM pages")
def missing_files(spark, sf_dir):
    """Tasks whose file is missing become error rows."""
    tasks = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("v"), F.col("page_id").cast("string")).alias("path"))
    good, bad = mix.errors_for_missing(tasks, tasks.where("page_id % 5 <> 0"))
    return good.select("page_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("p")).unionByName(bad.select("page_id", "error", "p"))


@query("SELECT doc_id, md5(text) AS query_text, md5(text) AS answer, CAST(length(text) + 1 AS INT) AS n_with_end FROM documents")
def trimmed_rollouts(spark, sf_dir):
    """Padding before a prompt and behind an answer removed."""
    ids, pad = Chars().encode(F.col("text")), F.array_repeat(F.lit(0), (F.col("doc_id") % 5).cast("int"))
    d = readers.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", metrics.trim_query(F.concat(pad, ids), 0).alias("q"), metrics.trim_response(F.concat(ids, pad), 0, 2).alias("a"), metrics.trim_response(F.concat(ids, pad, F.array(F.lit(0))), 0, 0).alias("e"))
    return d.select("doc_id", F.md5(Chars().decode(F.col("q"))).alias("query_text"), F.md5(Chars().decode(F.col("a"))).alias("answer"), F.size("e").alias("n_with_end"))



@query(CHAT_SQL + """, t AS (SELECT m.conv_id, i, m.n, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, trim(system, ' ' || chr(9) || chr(10) || chr(13)) AS system FROM m JOIN ok USING (conv_id) WHERE good AND ok.n > 0)
SELECT conv_id, CASE WHEN max(system) <> '' THEN '<|im_start|>system' || chr(10) || max(system) || '<|im_end|>' || chr(10) ELSE '' END || string_agg('<|im_start|>' || role || chr(10) || CASE WHEN i = n - 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10), '' ORDER BY i) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS text FROM t GROUP BY conv_id""")
def bundled_chat_format(spark, sf_dir):
    """Dialogues in the format that a bundled model brings along."""
    rows = validate.stage_filter(aligned(spark, sf_dir), "supervised")
    m = F.concat(F.when(F.col("_system") != "", messages(message("system", F.col("_system")))).otherwise(messages()), "_prompt", "_response")
    return rows.select("conv_id", chatformat.render(m, generate=True).alias("text"))


@query("SELECT doc_id, 'see <image> and <video> ' || lang AS content, 'image' AS kind, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'http://x/' || doc_id END AS path, CASE WHEN doc_id % 2 = 0 THEN md5('bytes ' || doc_id) END AS data, '[{\"name\": \"f\", \"arguments\": \"{}\"}]' AS call FROM documents")
def request_media(spark, sf_dir):
    """Typed parts of a request: text with marks, media by address or inline, and calls as JSON."""
    i = F.col("doc_id").cast("string")
    inline = F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("bytes "), i).cast("binary")))
    url = F.when(F.col("doc_id") % 2 == 0, inline).otherwise(F.concat(F.lit("http://x/"), i))
    part = lambda kind, text=None, at=None: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text") if text is None else text.alias("text"), (F.lit(None).cast("string") if at is None else at).alias("url"))
    parts = F.array(part("text", F.lit("see ")), part("image_url", at=url), part("text", F.lit(" and ")), part("video_url", at=F.lit("v.mp4")), part("text", F.concat(F.lit(" "), "lang")))
    call = requests.call_content(F.array(F.struct(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    d = table(spark, sf_dir, "documents").select("doc_id", requests.multimodal_text(parts).alias("content"), requests.request_media(parts)[0].alias("m"), call.alias("call"))
    return d.select("doc_id", "content", "m.kind", "m.path", F.md5("m.data").alias("data"), "call")


@query("SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN length(url) ELSE -1 END AS n, CASE WHEN page_id % 4 = 0 THEN 'ValueError: cannot read ' || page_id END AS error FROM pages")
def loaded_rows(spark, sf_dir):
    """Inputs loaded ahead in bounded groups; a row whose loading fails becomes an error row."""

    def load(row: dict) -> dict:
        if row["page_id"] % 4 == 0:
            raise ValueError(f"cannot read {row['page_id']}")
        return {"n": len(row["url"])}

    return mix.loaded(table(spark, sf_dir, "pages").select("page_id", "url"), load, "n bigint").select("page_id", F.coalesce("n", F.lit(-1)).alias("n"), "error")


_PAIRED = "x AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'assistant'), y AS (SELECT * FROM x WHERE b IS NOT NULL)"


@query(f"""
WITH {_PAIRED},
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(a, '\\s+'), lambda v: v <> '') AS a, list_filter(regexp_split_to_array(b, '\\s+'), lambda v: v <> '') AS b FROM y),
g AS (SELECT conv_id, turn, a, b, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS a2, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) AS b2, list_distinct(a) AS a1, list_distinct(b) AS b1 FROM w),
s AS (SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AS filled, len(list_intersect(a1, b1)) AS h1, len(a1) + len(b1) AS n1, len(list_intersect(a2, b2)) AS h2, len(a2) + len(b2) AS n2 FROM g),
c AS (SELECT conv_id, turn, a, b, n, i FROM y, (VALUES (1), (2), (3), (4)) v(n), range((SELECT max(greatest(length(a), length(b))) FROM y)) r(i) WHERE i <= greatest(length(a), length(b)) - n),
p AS (SELECT conv_id, turn, n, g, sum(s) FILTER (WHERE side = 0) AS ca, sum(s) FILTER (WHERE side = 1) AS cb FROM (
  SELECT conv_id, turn, n, substr(a, i + 1, n) AS g, 0 AS side, 1 AS s FROM c WHERE i <= length(a) - n UNION ALL SELECT conv_id, turn, n, substr(b, i + 1, n), 1, 1 FROM c WHERE i <= length(b) - n) GROUP BY ALL),
h AS (SELECT conv_id, turn, n, sum(least(coalesce(ca, 0), coalesce(cb, 0))) AS hits, greatest(1, sum(coalesce(ca, 0))) AS total FROM p GROUP BY conv_id, turn, n),
k AS (SELECT *, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS k FROM h),
l AS (SELECT conv_id, turn, sum(ln(CASE WHEN hits > 0 THEN hits / total ELSE 1.0 / (2 ** k * total) END) / 4) AS logs, count(*) AS orders, min(hits) FILTER (WHERE n = 1) AS first_hits FROM k GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN filled AND n1 > 0 THEN 200.0 * h1 / n1 ELSE 0 END, 4)::DOUBLE AS rouge_1, round(CASE WHEN filled AND n2 > 0 THEN 200.0 * h2 / n2 ELSE 0 END, 4)::DOUBLE AS rouge_2,
  round(CASE WHEN length(a) = 0 OR coalesce(first_hits, 0) = 0 THEN 0 ELSE 100 * CASE WHEN length(a) > length(b) THEN 1 ELSE exp(1 - length(b) / length(a)) END * exp(logs) END, 4)::DOUBLE AS bleu_4
FROM y JOIN s USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn) WHERE coalesce(orders, 4) = 4
""")
def overlap_scores(spark, sf_dir):
    """ROUGE-1, ROUGE-2 and BLEU-4 of consecutive answers, of those with four characters or more in either."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    scored = rows.where(F.greatest(F.length("text"), F.length("before")) >= 4).select("conv_id", "turn", metrics.text_overlap("text", "before").alias("s"))
    return scored.select("conv_id", "turn", *[F.col(f"s.{x}").alias(x) for x in ("rouge_1", "rouge_2", "bleu_4")])
