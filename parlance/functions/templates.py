"""Chat templates as data, compiled once on the driver to Column expressions.

A template is a set of slot lists. A slot is literal text with an optional ``{{content}}`` (only its first occurrence is replaced), BOS or EOS, or
a ``Token``. Compilation splits each slot at its placeholder, so a rendered turn is one ``concat`` of literals and columns that Catalyst
folds; no template is interpreted per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Token:
    text: str


BOS, EOS = Token("\0bos"), Token("\0eos")
CONTENT = "{{content}}"


@dataclass(frozen=True)
class Template:
    """kind: plain, llama2 (system text goes into the first user turn), reasoning, or glm47 (empty thought is the closing word only)."""

    user: tuple = (CONTENT,)
    assistant: tuple | None = None
    system: tuple = (CONTENT,)
    function: tuple | None = None
    observation: tuple | None = None
    prefix: tuple = ()
    default_system: str = ""
    stop_words: tuple[str, ...] = ()
    thought_words: tuple[str, str] = ("<think>\n", "\n</think>\n\n")
    tool_call_words: tuple[str, str] = ("<tool_call>", "</tool_call>")
    tool_format: str = "default"
    function_format: str = "default"
    efficient_eos: bool = False
    replace_eos: bool = False
    replace_jinja: bool = False
    kind: str = "plain"
    media: str = "base"
    media_tokens: dict = field(default_factory=dict)

    def slots(self, role: str) -> tuple:
        assistant = self.assistant or ((CONTENT,) if self.efficient_eos else (CONTENT, EOS))
        return {"user": self.user, "assistant": assistant, "system": self.system, "observation": self.observation or self.user, "function": self.function or assistant, "prefix": self.prefix}[role]

    @property
    def reasons(self) -> bool:
        return self.kind in ("reasoning", "glm47")

    @property
    def empty_thought(self) -> str:
        return self.thought_words[1] if self.kind == "glm47" else "".join(self.thought_words)


def _turn(start: str, end: str, reply: str, roles=("user", "assistant", "system", "tool")) -> dict:
    """Slots of a family whose turns are start-role-text-end; reply: what ends a role's header."""
    user, assistant, system, tool = roles
    open_reply = f"{start}{assistant}{reply}"
    return {"user": (f"{start}{user}{reply}{CONTENT}{end}{open_reply}",), "assistant": (f"{CONTENT}{end}",), "system": (f"{start}{system}{reply}{CONTENT}{end}",), "observation": (f"{start}{tool}{reply}{CONTENT}{end}{open_reply}",)}


def _without(slots: dict, *names: str) -> dict:
    return {k: v for k, v in slots.items() if k not in names}


def _tools(name: str, function: tuple | None = None) -> dict:
    return {"tool_format": name, "function_format": name} | ({"function": function} if function else {})


# The formats of public chat models.
_CHATML = _turn("<|im_start|>", "<|im_end|>\n", "\n")
_CHATML_BARE = _without(_CHATML, "observation")
_QWEN_OBSERVATION = ("<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n",)
_IM_END = {"stop_words": ("<|im_end|>",)}
_QWEN = _CHATML | {"observation": _QWEN_OBSERVATION, "replace_eos": True} | _IM_END | _tools("qwen", ("{{content}}<|im_end|>\n",))
_QWEN35 = _QWEN | _tools("qwen3_5")
_LFM2 = _CHATML | _IM_END | _tools("lfm2", ("{{content}}<|im_end|>\n",)) | {
    "observation": ("<|im_start|>tool\n<|tool_response_start|>{{content}}<|tool_response_end|><|im_end|>\n<|im_start|>assistant\n",), "tool_call_words": ("<|tool_call_start|>", "<|tool_call_end|>"), "replace_eos": True,
}
_LLAMA3 = _turn("<|start_header_id|>", "<|eot_id|>", "<|end_header_id|>\n\n", ("user", "assistant", "system", "ipython")) | _tools("llama3", ("{{content}}<|eot_id|>",)) | {"prefix": (BOS,), "stop_words": ("<|eot_id|>", "<|eom_id|>"), "replace_eos": True}
_GEMMA = _turn("<start_of_turn>", "<end_of_turn>\n", "\n", ("user", "model", "system", "tool")) | {"system": ("{{content}}\n\n",), "prefix": (BOS,), "stop_words": ("<end_of_turn>",), "replace_eos": True, "kind": "llama2"}
_GEMMA4 = _turn("<|turn>", "<turn|>\n", "\n", ("user", "model", "system", "tool")) | _tools("gemma4", ("<|tool>{{content}}<tool|>",)) | {
    "system": ("<|turn>system\n<|think|>{{content}}<turn|>\n",), "prefix": (BOS,), "stop_words": ("<turn|>",), "default_system": "You are a helpful assistant.",
    "thought_words": ("<|channel>thought\n", "<channel|>"), "replace_eos": True, "kind": "reasoning", "media": "gemma4",
}
_GLM4 = {
    "user": ("<|user|>\n{{content}}<|assistant|>",), "assistant": ("\n{{content}}",), "system": ("<|system|>\n{{content}}",), "observation": ("<|observation|>\n{{content}}<|assistant|>",),
    "prefix": ("[gMASK]<sop>",), "stop_words": ("<|user|>", "<|observation|>"), "efficient_eos": True,
} | _tools("glm4", (CONTENT,))
_GLM4_MOE = _GLM4 | _tools("glm4_moe")
_GLM4V = {"media": "glm4v", "media_tokens": {"image": "<|image|>", "video": "<|video|>"}}
_GLM_STOP3 = {"stop_words": ("<|user|>", "<|observation|>", "</answer>")}
_TIGHT_THINK = {"thought_words": ("<think>", "</think>")}
_VICUNA_SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_VICUNA = {"user": ("USER: {{content}} ASSISTANT:",), "default_system": _VICUNA_SYSTEM}
_MISTRAL = {
    "user": ("[INST] {{content}}[/INST]",), "assistant": (" {{content}}", EOS), "system": ("{{content}}\n\n",), "observation": ('[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]',), "prefix": (BOS,), "kind": "llama2",
} | _tools("mistral", ("[TOOL_CALLS] {{content}}", EOS))
_MINISTRAL = _without(_MISTRAL, "assistant") | {"user": ("[INST]{{content}}[/INST]",), "observation": ('[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]',), "function": ("[TOOL_CALLS]{{content}}", EOS)}
_KIMI = {"user": ("<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>",), "assistant": ("{{content}}<|im_end|>",), "system": ("<|im_system|>system<|im_middle|>{{content}}<|im_end|>",)} | _IM_END
_GRANITE = {
    "user": ("<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>",), "assistant": ("{{content}}<|end_of_text|>\n",), "system": ("<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n",),
}
_PHI = _without(_turn("<|", "<|end|>\n", "|>\n"), "observation") | {"stop_words": ("<|end|>",)}
_DEEPSEEK3 = {"user": ("<｜User｜>{{content}}<｜Assistant｜>",), "prefix": (BOS,)}
_SEED = {"user": (BOS, "user\n{{content}}", EOS, BOS, "assistant\n"), "system": (BOS, "system\n{{content}}", EOS)}
_LLAMA2 = {"user": (BOS, "[INST] {{content}} [/INST]"), "system": ("<<SYS>>\n{{content}}\n<</SYS>>\n\n",), "kind": "llama2"}
_REASONS = {"kind": "reasoning"}
_HELPFUL = {"default_system": "You are a helpful assistant."}


def _media(name: str, **tokens: str) -> dict:
    return {"media": name, "media_tokens": tokens}


_IMAGE = {"image": "<image>"}
_IMAGE_VIDEO = {"image": "<image>", "video": "<video>"}
_PAD = {"image": "<|image_pad|>", "video": "<|video_pad|>"}
_FORMATS: dict[str, dict] = {
    "alpaca": {
        "user": ("### Instruction:\n{{content}}\n\n### Response:\n",), "assistant": (CONTENT, EOS, "\n\n"), "replace_jinja": True,
        "default_system": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n",
    },
    "bailing": {
        "user": ("<role>HUMAN</role>{{content}}<role>ASSISTANT</role>",), "system": ("<role>SYSTEM</role>{{content}}",), "observation": ("<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>",),
        "stop_words": ("<|endoftext|>",), "efficient_eos": True,
    },
    "bailing_v2": {
        "user": ("<role>HUMAN</role>{{content}}<|role_end|><role>ASSISTANT</role>",), "system": ("<role>SYSTEM</role>{{content}}<|role_end|>",), "assistant": ("{{content}}<|role_end|>",),
        "observation": ("<role>OBSERVATION</role>\n<tool_response>\n{{content}}\n</tool_response><|role_end|><role>ASSISTANT</role>",), "stop_words": ("<|endoftext|>",), "efficient_eos": True,
    } | _tools("ling", ("{{content}}<|role_end|>",)),
    "breeze": {"user": ("[INST] {{content}} [/INST] ",), "prefix": (BOS,), "efficient_eos": True},
    "chatglm3": {
        "user": (Token("<|user|>"), "\n", CONTENT, Token("<|assistant|>")), "assistant": ("\n", CONTENT), "system": (Token("<|system|>"), "\n", CONTENT), "observation": (Token("<|observation|>"), "\n", CONTENT, Token("<|assistant|>")),
        "prefix": (Token("[gMASK]"), Token("sop")), "stop_words": ("<|user|>", "<|observation|>"), "efficient_eos": True,
    } | _tools("glm4", (CONTENT,)),
    "chatml": _CHATML | {"stop_words": ("<|im_end|>", "<|im_start|>"), "replace_eos": True, "replace_jinja": True},
    "chatml_de": _CHATML | {"stop_words": ("<|im_end|>", "<|im_start|>"), "replace_eos": True, "replace_jinja": True, "default_system": "Du bist ein freundlicher und hilfsbereiter KI-Assistent."},
    "cohere": {
        "user": ("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",), "system": ("<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>",), "prefix": (BOS,),
    },
    "cpm4": _CHATML | _IM_END | {"prefix": (BOS,)},
    "dbrx": _CHATML | _IM_END | {"replace_eos": True, "default_system": (
        "You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\n"
        "YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\n"
        "You assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n"
        "(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. "
        "You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\n"
        "This is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. "
        "You should be responding appropriately and usually that means not mentioning this.\n"
        "YOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."
    )},
    "deepseek": {"user": ("User: {{content}}\n\nAssistant:",), "system": ("{{content}}\n\n",), "prefix": (BOS,)},
    "deepseek3": _DEEPSEEK3,
    "deepseekr1": _DEEPSEEK3 | _REASONS,
    "hy3": {"user": ("<｜hy_User｜>{{content}}<｜hy_Assistant｜>",), "assistant": ("{{content}}<｜hy_eos｜>",), "prefix": (BOS,), "stop_words": ("<｜hy_eos｜>",), "replace_eos": True} | _TIGHT_THINK | _REASONS,
    "deepseekcoder": {
        "user": ("### Instruction:\n{{content}}\n### Response:",), "assistant": ("\n{{content}}\n<|EOT|>\n",), "prefix": (BOS,),
        "default_system": (
            "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. "
            "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"
        ),
    },
    "default": {"user": ("Human: {{content}}", EOS, "\nAssistant:"), "assistant": (CONTENT, EOS, "\n"), "system": ("System: {{content}}", EOS, "\n"), "replace_jinja": True},
    "dots_ocr": {
        "user": ("<|user|>{{content}}<|endofuser|><|assistant|>",), "assistant": ("{{content}}<|endofassistant|>",), "system": ("<|system|>{{content}}<|endofsystem|>\n",), "stop_words": ("<|endofassistant|>",), "efficient_eos": True,
    } | _media("qwen2_vl", image="<|imgpad|>", video="<|vidpad|>", vision_bos="<|img|>", vision_eos="<|endofimg|>"),
    "empty": {"assistant": (CONTENT,)},
    "ernie": _turn("<|im_start|>", "<|im_end|>\n\n", "\n") | _IM_END | {"default_system": "<global_setting>\nthink_mode=True\n</global_setting>"},
    "ernie_nothink": {"user": ("User: {{content}}\nAssistant: ",), "assistant": ("{{content}}<|end_of_sentence|>",), "system": ("{{content}}\n",), "prefix": ("<|begin_of_sentence|>",), "stop_words": ("<|end_of_sentence|>",)},
    "ernie_vl": {
        "user": ("User: {{content}}",), "assistant": ("\nAssistant: {{content}}<|end_of_sentence|>",), "system": ("{{content}}\n",), "stop_words": ("<|end_of_sentence|>",), "replace_eos": True, "replace_jinja": True,
    } | _REASONS | _media("ernie_vl", image="<|IMAGE_PLACEHOLDER|>", video="<|VIDEO_PLACEHOLDER|>"),
    "exaone": {"user": ("[|user|]{{content}}\n[|assistant|]",), "assistant": (CONTENT, EOS, "\n"), "system": ("[|system|]{{content}}[|endofturn|]\n",)},
    "falcon": {"user": ("User: {{content}}\nFalcon:",), "assistant": ("{{content}}\n",), "efficient_eos": True},
    "falcon_h1": _CHATML | {"prefix": (BOS,), "stop_words": ("<|im_end|>", "<|end_of_text|>")},
    "fewshot": {"assistant": ("{{content}}\n\n",), "efficient_eos": True, "replace_jinja": True},
    "gemma": _GEMMA,
    "gemma2": _GEMMA | {"stop_words": ("<eos>", "<end_of_turn>"), "efficient_eos": True, "replace_eos": False},
    "gemma3": _GEMMA | _media("gemma3", image="<image_soft_token>"),
    "gemma3n": _GEMMA | _media("gemma3n", image="<image_soft_token>", audio="<audio_soft_token>"),
    "gemma4": _GEMMA4 | {"media_tokens": {"image": "<|image|>", "video": "<|video|>"}},
    "gemma4n": _GEMMA4 | {"media_tokens": {"image": "<|image|>", "video": "<|video|>", "audio": "<|audio|>"}},
    "glm4": _GLM4,
    "glm4_moe": _GLM4_MOE | _REASONS,
    "glm4v": _GLM4 | _GLM_STOP3 | _GLM4V | _REASONS,
    "glm4_5v": _GLM4_MOE | _GLM_STOP3 | _GLM4V | _REASONS,
    "glm_ocr": _GLM4 | _GLM4V,
    "glm4_7": _GLM4_MOE | _TIGHT_THINK | {"kind": "glm47"},
    "glmz1": _GLM4 | _REASONS,
    "gpt_oss": {
        "user": ("<|start|>user<|message|>{{content}}<|end|><|start|>assistant",), "assistant": (CONTENT,), "system": ("<|start|>system<|message|>{{content}}<|end|>",), "default_system": "You are ChatGPT, a large language model trained by OpenAI.",
        "thought_words": ("<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"), "efficient_eos": True,
    } | _REASONS,
    "granite3": _GRANITE,
    "granite3_vision": {"user": ("<|user|>\n{{content}}\n<|assistant|>\n",), "system": ("<|system|>\n{{content}}\n",), "default_system": _VICUNA_SYSTEM} | _media("llava_next", **_IMAGE),
    "granite4": _GRANITE | _tools("default", ("{{content}}<|end_of_text|>\n",)) | {
        "observation": ("<|start_of_role|>tool<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant\n",), "stop_words": ("<|end_of_text|>",), "default_system": "You are Granite, developed by IBM. You are a helpful AI assistant.",
    },
    "index": {"user": ("reserved_0{{content}}reserved_1",), "system": ("<unk>{{content}}",), "efficient_eos": True},
    "hunyuan": {"user": ("{{content}}<|extra_0|>",), "assistant": ("{{content}}<|eos|>",), "system": ("{{content}}<|extra_4|>",), "prefix": ("<|startoftext|>",), "stop_words": ("<|eos|>",)},
    "hunyuan_small": {
        "user": ("<｜hy_User｜>{{content}}<｜hy_place▁holder▁no▁8｜>",), "assistant": ("{{content}}<｜hy_place▁holder▁no▁2｜>",), "system": ("{{content}}<｜hy_place▁holder▁no▁3｜>",), "prefix": ("<｜hy_begin▁of▁sentence｜>",),
        "stop_words": ("<｜hy_place▁holder▁no▁2｜>",),
    },
    "intern2": _CHATML_BARE | _IM_END | {"prefix": (BOS,), "default_system": (
        "You are an AI assistant whose name is InternLM (书生·浦语).\n"
        "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
        "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
    )},
    "intern_vl": _CHATML_BARE | _IM_END | {"prefix": (BOS,), "default_system": "你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。"} | _media("intern_vl", **_IMAGE_VIDEO),
    "intern_s1": _CHATML_BARE | _IM_END | {"prefix": (BOS,)} | _media("intern_vl", **_IMAGE_VIDEO),
    "keye_vl": _QWEN | _REASONS | _media("qwen2_vl", **_PAD),
    "kimi_vl": _KIMI | _REASONS | {"default_system": "You are a helpful assistant", "thought_words": ("◁think▷", "◁/think▷")} | _media("kimi_vl", image="<|media_pad|>"),
    "lfm2": _LFM2 | {"default_system": "You are a helpful AI assistant."},
    "lfm2_vl": _LFM2 | {"default_system": "You are a helpful multimodal assistant by Liquid AI."} | _media("lfm2_vl", **_IMAGE),
    "llama2": _LLAMA2,
    "llama2_zh": _LLAMA2 | {"default_system": "You are a helpful assistant. 你是一个乐于助人的助手。"},
    "llama3": _LLAMA3,
    "llama4": _LLAMA3 | _turn("<|header_start|>", "<|eot|>", "<|header_end|>\n\n", ("user", "assistant", "system", "ipython")) | {"function": ("{{content}}<|eot|>",), "stop_words": ("<|eot|>", "<|eom|>")} | _media("llama4", image="<|image|>"),
    "mllama": _LLAMA3 | _media("mllama", image="<|image|>"),
    "moonlight": _KIMI | {"default_system": "You are a helpful assistant provided by Moonshot-AI.", "replace_eos": True},
    "llava": _VICUNA | _media("llava", **_IMAGE),
    "llava_next": _VICUNA | _media("llava_next", **_IMAGE),
    "llava_next_llama3": _LLAMA3 | _media("llava_next", **_IMAGE),
    "llava_next_mistral": _MISTRAL | _media("llava_next", **_IMAGE),
    "llava_next_qwen": _QWEN | _HELPFUL | _media("llava_next", **_IMAGE),
    "llava_next_yi": _CHATML_BARE | _IM_END | _media("llava_next", **_IMAGE),
    "llava_next_video": _VICUNA | _media("llava_next_video", **_IMAGE_VIDEO),
    "llava_next_video_mistral": _MISTRAL | _media("llava_next_video", **_IMAGE_VIDEO),
    "llava_next_video_yi": _CHATML_BARE | _IM_END | _media("llava_next_video", **_IMAGE_VIDEO),
    "mimo": _QWEN | _HELPFUL | _REASONS,
    "mimo_v2": _QWEN | _REASONS | _TIGHT_THINK | {"default_system": "You are MiMo, a helpful AI assistant engineered by Xiaomi."},
    "mimo_vl": _QWEN | _REASONS | {"default_system": "You are MiMo, an AI assistant developed by Xiaomi."} | _media("qwen2_vl", **_PAD),
    "minicpm_v": _CHATML_BARE | _IM_END | _HELPFUL | _media("minicpm_v", **_IMAGE_VIDEO),
    "minicpm_o": _CHATML_BARE | _IM_END | {"default_system": "You are a helpful assistant. You can accept audio and text input and output voice and text."} | _media("minicpm_v", audio="<audio>", **_IMAGE_VIDEO),
    "minimax1": {
        "user": ("<beginning_of_sentence>user name=user\n{{content}}<end_of_sentence>\n<beginning_of_sentence>ai name=assistant\n",), "assistant": ("{{content}}<end_of_sentence>\n",),
        "system": ("<beginning_of_sentence>system ai_setting=assistant\n{{content}}<end_of_sentence>\n",), "observation": ("<beginning_of_sentence>tool name=tools\n{{content}}<end_of_sentence>\n<beginning_of_sentence>ai name=assistant\n",),
        "stop_words": ("<end_of_sentence>",),
    } | _HELPFUL | _tools("minimax1", ("{{content}}<end_of_sentence>\n",)),
    "minimax2": {
        "user": ("]~b]user\n{{content}}[e~[\n]~b]ai\n",), "assistant": ("{{content}}[e~[\n",), "system": ("]~!b[]~b]system\n{{content}}[e~[\n",), "observation": ("]~b]tool\n<response>{{content}}</response>[e~[\n]~b]ai\n",),
        "default_system": "You are a helpful assistant. Your name is MiniMax-M2.1 and is built by MiniMax.", "stop_words": ("[e~[",),
    } | _REASONS | _tools("minimax2", ("{{content}}[e~[\n",)),
    "ministral": _MINISTRAL,
    "mistral": _MISTRAL,
    "mistral_small": _MINISTRAL | {"system": ("[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]",), "kind": "plain"} | _media("pixtral", image="[IMG]"),
    "ministral3": _MINISTRAL | _media("pixtral", image="[IMG]"),
    "olmo": {"user": ("<|user|>\n{{content}}<|assistant|>\n",), "prefix": (EOS,)},
    "openchat": {"user": ("GPT4 Correct User: {{content}}", EOS, "GPT4 Correct Assistant:"), "prefix": (BOS,)},
    "openchat-3.6": {"user": ("<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n",), "prefix": (BOS,), "stop_words": ("<|eot_id|>",)},
    "opencoder": _CHATML | _IM_END | {"default_system": "You are OpenCoder, created by OpenCoder Team."},
    "paligemma": {"user": ("{{content}}\n",), "prefix": (BOS,), "kind": "llama2"} | _media("paligemma", **_IMAGE),
    "paligemma_chat": _without(_GEMMA, "system") | _media("paligemma", **_IMAGE),
    "phi": _PHI | {"replace_eos": True},
    "phi_small": _PHI | {"replace_eos": True, "prefix": (Token("\0none"),)},
    "phi4": {"user": ("<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>",), "assistant": ("{{content}}<|im_end|>",), "system": ("<|im_start|>system<|im_sep|>{{content}}<|im_end|>",), "replace_eos": True} | _IM_END,
    "phi4_mini": {"user": ("<|user|>{{content}}<|end|><|assistant|>",), "assistant": ("{{content}}<|end|>",), "system": ("<|system|>{{content}}<|end|>",), "stop_words": ("<|end|>",), "replace_eos": True, "tool_format": "\0<|tool|>{{content}}<|/tool|>"},
    "pixtral": _MINISTRAL | _media("pixtral", image="[IMG]"),
    "qwen": _QWEN | {"default_system": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."},
    "qwen3": _QWEN | _REASONS,
    "qwen3_nothink": _QWEN,
    "qwen2_audio": _CHATML_BARE | _IM_END | _HELPFUL | {"replace_eos": True} | _media("qwen2_audio", audio="<|AUDIO|>"),
    "qwen2_omni": _QWEN | _HELPFUL | _media("qwen2_omni", image="<|IMAGE|>", video="<|VIDEO|>", audio="<|AUDIO|>", vision_bos="<|vision_bos|>", vision_eos="<|vision_eos|>", audio_bos="<|audio_bos|>", audio_eos="<|audio_eos|>"),
    "qwen3_omni": _QWEN | _REASONS | _media("qwen2_omni", audio="<|audio_pad|>", **_PAD),
    "qwen3_omni_nothink": _QWEN | _media("qwen2_omni", audio="<|audio_pad|>", **_PAD),
    "qwen2_vl": _QWEN | _HELPFUL | _media("qwen2_vl", **_PAD),
    "qwen3_vl": _QWEN | _REASONS | _media("qwen3_vl", **_PAD),
    "qwen3_vl_nothink": _QWEN | _media("qwen3_vl", **_PAD),
    "qwen3_5": _QWEN35 | _REASONS | _media("qwen3_vl", **_PAD),
    "qwen3_5_nothink": _QWEN35 | _media("qwen3_vl", **_PAD),
    "qwen3_6": _QWEN35 | _REASONS | _media("qwen3_vl", **_PAD),
    "sailor": _without(_turn("<|im_start|>", "<|im_end|>\n", "\n", ("question", "answer", "system", "tool")), "observation") | _IM_END | {
        "default_system": "You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed.",
    },
    "seed_coder": _SEED | {"default_system": (
        "You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. "
        "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"
    )},
    "seed_oss": _SEED | _REASONS | _tools("seed_oss", (BOS, "\n{{content}}", EOS)) | {"thought_words": ("<seed:think>", "</seed:think>")},
    "smollm": _CHATML_BARE | _IM_END,
    "smollm2": _CHATML_BARE | _IM_END | {"default_system": "You are a helpful AI assistant named SmolLM, trained by Hugging Face."},
    "solar": {"user": ("### User:\n{{content}}\n\n### Assistant:\n",), "system": ("### System:\n{{content}}\n\n",), "efficient_eos": True},
    "starchat": _PHI | {"user": ("<|user|>\n{{content}}<|end|>\n<|assistant|>",)},
    "telechat2": {"user": ("<_user>{{content}}<_bot>",), "system": ("<_system>{{content}}",), "default_system": "你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"},
    "vicuna": _VICUNA | {"replace_jinja": True},
    "video_llava": _VICUNA | _media("video_llava", **_IMAGE_VIDEO),
    "xuanyuan": {"user": ("Human: {{content}} Assistant:",), "default_system": (
        "以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"
    )},
    "yi": _CHATML_BARE | _IM_END,
    "yi_vl": {"user": ("### Human: {{content}}\n### Assistant:",), "assistant": ("{{content}}\n",), "stop_words": ("###",), "efficient_eos": True, "default_system": (
        "This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, "
        "and respond to the human's questions with informative, helpful, detailed and polite answers. "
        "这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"
    )} | _media("llava", **_IMAGE),
    "youtu": {
        "user": ("<|User|>{{content}}<|Assistant|>",), "assistant": ("{{content}}<|end_of_text|>",), "observation": ("<tool_response>\n{{content}}\n</tool_response><|Assistant|>",), "prefix": (BOS,), "stop_words": ("<|end_of_text|>",), "replace_eos": True,
    } | _REASONS | _tools("default", (CONTENT,)),
    "youtu_vl": _without(_turn("<|begin_of_text|>", "<|end_of_text|>\n", "\n"), "observation") | _HELPFUL | {"stop_words": ("<|end_of_text|>",)} | _media("youtu_vl", **_PAD),
    "yuan": {"user": (CONTENT, Token("<sep>")), "assistant": ("{{content}}<eod>\n",), "stop_words": ("<eod>",)},
    "zephyr": {"user": ("<|user|>\n{{content}}", EOS, "<|assistant|>\n"), "system": ("<|system|>\n{{content}}", EOS), "default_system": "You are Zephyr, a helpful assistant."},
    "aeva": _GLM4_MOE | _TIGHT_THINK | {"kind": "glm47", "default_system": "You are an AI assistant named Aeva created by Zongzhi Lou. Your answer should be friendly, unbiased, faithful, informative and detailed."},
}
REGISTRY: dict[str, Template] = {name: Template(**spec) for name, spec in _FORMATS.items()}


def register(name: str, template: Template) -> None:
    if name in REGISTRY:
        raise ValueError(f"template {name} exists")
    REGISTRY[name] = template


def resolve(name: str | None, train_on_prompt: bool = False, **overrides) -> Template:
    """A template with overrides, as a copy; None is the empty template."""
    if (name or "empty") not in REGISTRY:
        raise ValueError(f"template {name} doesn't exist")
    found = REGISTRY[name or "empty"]
    if train_on_prompt and found.efficient_eos:
        raise ValueError("this template's end mark doesn't allow training on prompts")
    return replace(found, **overrides) if overrides else found


def _text(slot, bos: str, eos: str) -> str:
    if isinstance(slot, Token):
        return {BOS: bos, EOS: eos}.get(slot, "" if slot.text.startswith("\0") else slot.text)
    return slot


def fill(slots: tuple, content: Column, bos: str, eos: str) -> Column:
    """Slots as one concat; in each slot the first placeholder is replaced. Neighbouring literals are joined on the driver."""
    parts: list = [""]
    for slot in slots:
        before, found, after = _text(slot, bos, eos).partition(CONTENT)
        parts[-1] += before
        if found:
            parts += [content, after]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts if not isinstance(p, str) or p] or [F.lit("")])


def encode(t: Template, messages: Column, system: Column | str | None = None, tools: Column | None = None, bos: str = "<s>", eos: str = "</s>") -> Column:
    """array<string>: each message rendered, message 0 with prefix, system and tool text. tools: the rendered tool prompt or null.

    Function turns must hold rendered calls (parlance.functions.toolcalls.render_turns, which makes them a column first).
    """
    system = F.lit(system) if system is None or isinstance(system, str) else system
    system = F.coalesce(F.nullif(system, F.lit("")), F.lit(t.default_system))
    head = F.concat(system, F.coalesce(tools, F.lit(""))) if tools is not None else system
    has_head = (system != "") | (tools.isNotNull() & (tools != "")) if tools is not None else system != ""
    block = F.when(has_head, fill(t.slots("system"), head, bos, eos)).otherwise(F.lit(""))
    prefix = fill(t.slots("prefix"), F.lit(""), bos, eos)

    def one(m: Column, i: Column) -> Column:
        first, content = i == 0, m["content"]
        user = F.concat(F.when(first, block).otherwise(F.lit("")), content) if t.kind == "llama2" else content
        turn = F.when(m["role"] == "user", fill(t.slots("user"), user, bos, eos))
        for role in ("assistant", "observation", "function"):
            turn = turn.when(m["role"] == role, fill(t.slots(role), content, bos, eos))
        turn = turn.otherwise(F.raise_error(F.concat(F.lit("unexpected role: "), m["role"])).cast("string"))
        return F.concat(F.when(first, prefix if t.kind == "llama2" else F.concat(prefix, block)).otherwise(F.lit("")), turn)

    return F.transform(messages, one)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in text)


def strip_thought(t: Template, content: Column) -> Column:
    """Thought blocks removed, then leading line breaks."""
    a, b = (_quoted(w) for w in t.thought_words)
    return F.regexp_replace(F.regexp_replace(content, f"(?s){a}(.*?){b}", ""), "^\n+", "")


def _has_thought(t: Template, content: Column) -> Column:
    return content.contains(t.thought_words[0].strip()) | content.contains(t.thought_words[1].strip())


def _map_content(messages: Column, where, fn) -> Column:
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(where(i), fn(m["content"])).otherwise(m["content"]).alias("content")))


def one_turn(t: Template, messages: Column, system=None, tools=None, thinking: bool | None = True, preserve: bool = False, bos: str = "<s>", eos: str = "</s>") -> Column:
    """struct(prompt, response): all messages but the last, and the last."""
    n = F.size(messages)
    if t.reasons:
        if not preserve:
            messages = _map_content(messages, lambda i: (i % 2 == 1) & (i < n - 2), lambda c: strip_thought(t, c))
        if thinking is False:
            messages = _map_content(messages, lambda i: i == n - 1, lambda c: strip_thought(t, c))
    turns = encode(t, messages, system, tools, bos, eos)
    prompt, response = F.array_join(F.slice(turns, 1, n - 1), ""), F.element_at(turns, -1)
    if t.reasons:
        bare = ~_has_thought(t, F.element_at(messages, -1)["content"])
        empty = F.when(bare, F.lit(t.empty_thought)).otherwise(F.lit(""))
        prompt, response = (F.concat(prompt, empty), response) if not thinking else (prompt, F.concat(empty, response))
    return F.struct(prompt.alias("prompt"), response.alias("response"))


def multi_turn(t: Template, messages: Column, system=None, tools=None, thinking: bool | None = True, discard_history: bool = False, bos: str = "<s>", eos: str = "</s>") -> Column:
    """array<struct(prompt, response)>: messages two by two."""
    n = F.size(messages)
    if t.reasons:
        if thinking is False:
            messages = _map_content(messages, lambda i: i % 2 == 1, lambda c: strip_thought(t, c))
        if discard_history:
            messages = _map_content(messages, lambda i: (i % 2 == 1) & (i < n - 2), lambda c: strip_thought(t, c))
    turns = encode(t, messages, system, tools, bos, eos)

    def pair(i: Column) -> Column:
        prompt, response = F.get(turns, i), F.get(turns, i + 1)
        if t.reasons:
            bare = ~_has_thought(t, F.get(messages, i + 1)["content"])
            if discard_history:
                bare = bare & (i == n - 2)
            empty = F.when(bare, F.lit(t.empty_thought)).otherwise(F.lit(""))
            prompt, response = (F.concat(prompt, empty), response) if not thinking else (prompt, F.concat(empty, response))
        return F.struct(prompt.alias("prompt"), response.alias("response"))

    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), pair)).otherwise(F.array().cast("array<struct<prompt:string,response:string>>"))


def stop_words(t: Template, eos: str) -> list[str]:
    """Distinct words that end generation."""
    return list(dict.fromkeys([eos, *t.stop_words]))


def special_tokens(t: Template, eos: str | None, pad: str | None) -> dict[str, object]:
    """End, padding and additional tokens after the template's fixes."""
    rest = list(t.stop_words)
    if t.replace_eos:
        if not rest:
            raise ValueError("stop words are needed to replace the end token")
        eos, rest = rest[0], rest[1:]
    eos = eos or "<|endoftext|>"
    return {"eos": eos, "pad": pad or eos, "additional": rest}


def to_jinja(t: Template, bos: str = "<s>", eos: str = "</s>") -> str:
    """A Jinja chat template of the same turns."""

    def expr(slots: tuple, name: str) -> str:
        parts = []
        for s in slots:
            before, found, after = _text(s, bos, eos).partition(CONTENT)
            parts += [repr(before)] * bool(before) + [name] * bool(found) + [repr(after)] * bool(after)
        return " + ".join(parts)

    out = "{{ " + expr(t.slots("prefix"), "") + " }}" if t.slots("prefix") else ""
    if t.default_system:
        out += "{% set system_message = " + repr(t.default_system) + " %}"
    out += "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% endif %}"
    system = expr(t.slots("system"), "system_message")
    if t.kind != "llama2":
        out += "{% if system_message is defined %}{{ " + system + " }}{% endif %}"
    out += "{% for message in loop_messages %}"
    out += "{% set content = " + ("(" + system + " if loop.index0 == 0 and system_message is defined else '') + message['content']" if t.kind == "llama2" else "message['content']") + " %}"
    return out + "{% if message['role'] == 'user' %}{{ " + expr(t.slots("user"), "content") + " }}{% elif message['role'] == 'assistant' %}{{ " + expr(t.slots("assistant"), "content") + " }}{% endif %}{% endfor %}"


def to_modelfile(t: Template, bos: str = "<s>", eos: str = "</s>") -> str:
    """A model file whose TEMPLATE section renders the same turns."""
    put = lambda slots, name: "".join(_text(s, bos, eos).replace(CONTENT, name, 1) for s in slots)
    body = put(t.slots("prefix"), "") + "{{ if .System }}" + put(t.slots("system"), "{{ .System }}") + "{{ end }}{{ range .Messages }}"
    body += '{{ if eq .Role "user" }}' + put(t.slots("user"), "{{ .Content }}") + '{{ else if eq .Role "assistant" }}' + put(t.slots("assistant"), "{{ .Content }}") + "{{ end }}{{ end }}"
    lines = ["FROM .", "", f'TEMPLATE """{body}"""', ""]
    if t.default_system:
        lines += [f'SYSTEM """{t.default_system}"""', ""]
    return "\n".join(lines + [f'PARAMETER stop "{w}"' for w in stop_words(t, eos)] + ["PARAMETER num_ctx 4096", ""])


def infer(render, prefix: str = "") -> Template:
    """A template from a chat renderer: render(messages, add_generation_prompt) -> text, prefix: what every text begins with.

    Slots are what probe messages render to. The default system text is what a lone user turn has more than one behind an empty system turn,
    found between the two texts' common ends.
    """
    mark = {"content": CONTENT}
    say = lambda messages, go: render(messages, go)[len(prefix) :]
    system = say([{"role": "system"} | mark], False)
    bare = say([{"role": "system", "content": ""}, {"role": "user"} | mark], True)
    user = say([{"role": "user"} | mark], True)
    answer = say([{"role": "user"} | mark, {"role": "assistant"} | mark], False)[len(user) :]
    reasons = "<think>" in answer
    answer = answer.replace("<think>", "").replace("</think>", "").lstrip("\n")
    default = ""
    if len(user) > len(bare):
        front = next((i for i, (a, b) in enumerate(zip(user, bare)) if a != b), len(bare))
        default = user[front : front + len(user) - len(bare)]
        user = user[len(system.replace(CONTENT, default, 1)) :]
    return Template(user=(user,), assistant=(answer,), system=(system,), function=(answer,), observation=(user,), prefix=(prefix,) if prefix else (), default_system=default, kind="reasoning" if reasons else "plain")
