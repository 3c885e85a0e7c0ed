"""Media token arithmetic: sizes, frames and placeholder expansion from metadata columns; no pixel is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.schema import AUDIO, IMAGE, VIDEO


def _int(c: Column) -> Column:
    return c.cast("bigint")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def area_limits(width: Column, height: Column, most: int, least: int) -> tuple[Column, Column]:
    """Size after shrinking to most pixels, then growing to least."""
    for bound, over in ((most, True), (least, False)):
        area = width * height
        hit = area > bound if over else area < bound
        factor = F.sqrt(F.lit(float(bound)) / area)
        width, height = F.when(hit, _int(width * factor)).otherwise(width), F.when(hit, _int(height * factor)).otherwise(height)
    return width, height


def vision_size(width: Column, height: Column, most: int, least: int) -> tuple[Column, Column]:
    """area_limits, then at least 28 a side and a ratio of 200 at most (set to 180)."""
    w, h = area_limits(width, height, most, least)
    small = F.least(w, h) < 28
    w, h = F.when(small, F.greatest(w, F.lit(28))).otherwise(w), F.when(small, F.greatest(h, F.lit(28))).otherwise(h)
    w = F.when(w / h > 200, h * 180).otherwise(w)
    return w, F.when(h / w > 200, w * 180).otherwise(h)


def sampled_frames(total: Column, seconds: Column, fps: float, most: int) -> Column:
    """Frames taken of a video; one of unknown length gives most."""
    wanted = F.greatest(F.lit(1), F.floor(seconds * fps))
    return F.when(total == 0, F.lit(most)).otherwise(F.least(total, F.lit(most), wanted)).cast("int")


def frame_indices(total: Column, frames: Column) -> Column:
    """Evenly spaced frame numbers, cut to integers; the end is exact."""
    last = F.when(total == 0, frames - 1).otherwise(total - 1)
    at = lambda i: F.when(i == frames - 1, last).otherwise(F.floor(i * (last.cast("double") / (frames - 1)))).cast("int")
    return F.when(frames == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), frames - 1), at))


def even(frames: Column) -> Column:
    return frames + frames % 2


def video_grid(frames: Column, height: Column, width: Column, patch: int = 14, temporal: int = 2) -> Column:
    """struct(t, h, w) of a video resized to multiples of a patch."""
    return F.struct(F.ceil(frames / temporal).cast("bigint").alias("t"), F.floor(height / patch).cast("bigint").alias("h"), F.floor(width / patch).cast("bigint").alias("w"))


def smart_resize(height: Column, width: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Sides as multiples of factor with an area between least and most, the ratio kept near."""
    near = lambda x: F.greatest(F.lit(factor), F.bround(x / factor).cast("bigint") * factor)
    h, w = near(height), near(width)
    shrink, grow = F.sqrt(height * width / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (height * width))
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor)
    up = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda x, y: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(y).cast("bigint")
    return pick(height, h), pick(width, w)


def clip_fps(frames: Column, seconds: Column, fps: float) -> tuple[Column, Column]:
    """(frames per second, seconds) of a sampled video; unknown seconds follow fps."""
    return F.when(seconds.isNull(), F.lit(fps)).otherwise(frames / seconds), F.coalesce(seconds, frames / fps)


def pixels(text: Column) -> Column:
    """A pixel budget written as a number or as width*height."""
    parts = F.split(text, r"\*")
    return F.aggregate(parts, F.lit(1).cast("bigint"), lambda a, x: a * F.trim(x).cast("bigint"))


# Token counts of each family. Arguments are metadata columns or numbers.


def grid_tokens(t, h, w, merge: int = 2) -> Column:
    return F.floor(_col(t) * _col(h) * _col(w) / (merge * merge)).cast("bigint")


def patch_tokens(height, width, patch: int, extra: int = 0) -> Column:
    return (F.floor(_col(height) / patch) * F.floor(_col(width) / patch) + extra).cast("bigint")


def audio_tokens_strided(mel: Column) -> Column:
    """Two convolutions of stride 2."""
    return F.floor((F.floor((mel - 1) / 2) + 1 - 2) / 2).cast("bigint") + 1


def audio_tokens_chunked(mel: Column) -> Column:
    """100 mel frames give 13 tokens; what is left passes three convolutions of stride 2."""
    rest = mel % 100
    after = F.floor((rest - 1) / 2) + 1
    return (F.floor((F.floor((after - 1) / 2) + 1 - 1) / 2) + 1 + F.floor(mel / 100) * 13).cast("bigint")


def next_tokens(height: Column, width: Column, best_height: Column, best_width: Column, patch: int, size: int) -> Column:
    """Base patches, unpadded high-resolution patches and a break per row."""
    side = size // patch
    rows, cols = F.floor(best_height / size) * side, F.floor(best_width / size) * side
    wide = (width / height) > (cols / rows)
    kept_rows = F.when(wide, rows - 2 * F.floor((rows - F.floor(height * cols / width)) / 2)).otherwise(rows)
    kept_cols = F.when(wide, cols).otherwise(cols - 2 * F.floor((cols - F.floor(width * rows / height)) / 2))
    return (kept_rows * kept_cols + kept_rows + side * side).cast("bigint")


def pixtral_text(height: Column, width: Column, patch: int, token: str, row_break: str, end: str) -> Column:
    """Rows of tokens, each closed by a break, the last by the end mark."""
    rows, cols = F.floor(height / patch).cast("int"), F.floor(width / patch).cast("int")
    row = F.concat(F.repeat(F.lit(token), cols), F.lit(row_break))
    return F.concat(F.repeat(row, rows - 1), F.repeat(F.lit(token), cols), F.lit(end))


def tiled_text(ratio_h: Column, ratio_w: Column, per_chunk: Column, patch: str = "<|patch|>", x: str = "<|tile_x_separator|>", y: str = "<|tile_y_separator|>", image: str = "<|image|>", start: str = "<|image_start|>", end: str = "<|image_end|>") -> Column:
    """Tiles row by row with separators, then the whole image."""
    tile = F.repeat(F.lit(patch), per_chunk)
    row = F.concat(F.array_join(F.array_repeat(tile, ratio_w), x), F.lit(y))
    tiles = F.when(ratio_h * ratio_w > 1, F.repeat(row, ratio_h)).otherwise(F.lit(""))
    return F.concat(F.lit(start), tiles, F.lit(image), tile, F.lit(end))


def clock(seconds: Column) -> Column:
    """mm:ss of a number of seconds."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)


def expand(content: Column, mark: str, texts: Column, offset: Column | int = 0) -> Column:
    """content with its k-th mark replaced by texts[offset + k]; marks beyond the list stay. Both arrays are made once, not once for each mark."""
    parts = F.split(content, mark.replace("|", r"\|"), -1)
    n = F.size(parts)
    filled = F.zip_with(F.slice(parts, 1, n - 1), F.slice(texts, F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, n - 1), lambda p, t: F.concat(p, F.coalesce(t, F.lit(mark))))
    return F.concat(F.array_join(filled, ""), F.element_at(parts, -1))


def expand_messages(messages: Column, mark: str, texts: Column) -> Column:
    """Marks replaced in order over all messages."""
    seen = lambda i: F.aggregate(F.slice(messages, 1, i), F.lit(0), lambda a, m: a + F.size(F.split(m["content"], mark, -1)) - 1)
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), expand(m["content"], mark, texts, seen(i)).alias("content")))


def frames_text(times: Column, frames: Column, one) -> Column:
    """one(time, frame number) for each of so many frames; where times are fewer, the last (or 0) stands for the rest."""
    at = lambda i: F.coalesce(F.get(times, i), F.try_element_at(times, F.lit(-1)), F.lit(0.0))
    numbers = F.when(frames > 0, F.sequence(F.lit(0), frames.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: one(at(i), i))


def chunk_sizes(times: Column, tokens: Column, chunk: int) -> Column:
    """Sizes of the time chunks of a video's tokens: each frame has so many tokens at its time; a token past the chunk's end closes it, one chunk a token."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("now"), F.lit(1).alias("chunk"))

    def step(acc: Column, t: Column) -> Column:
        crossed = F.least(F.greatest(F.floor(t / chunk).cast("int") + 1 - acc["chunk"], F.lit(0)), tokens.cast("int"))
        closed = F.concat(acc["out"], F.array(acc["now"]), F.array_repeat(F.lit(1), crossed - 1))
        return F.struct(
            F.when(crossed > 0, closed).otherwise(acc["out"]).alias("out"),
            F.when(crossed > 0, tokens.cast("int") - (crossed - 1)).otherwise(acc["now"] + tokens.cast("int")).alias("now"),
            (acc["chunk"] + crossed).alias("chunk"),
        )

    return F.aggregate(times, start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))


def audio_in_video(video: Column, audio_tokens: Column, k: dict, per_second: int = 25) -> Column:
    """A video's tokens and its sound's, chunk by chunk of two seconds. video: t, h, w and second_per_grid."""
    chunk = per_second * 2
    times = F.transform(F.sequence(F.lit(0), video["t"].cast("int") - 1), lambda f: F.floor(f * video["second_per_grid"] * per_second))
    seen = chunk_sizes(times, grid_tokens(1, video["h"], video["w"]), chunk)
    whole, rest = F.floor(audio_tokens / chunk).cast("int"), (audio_tokens % chunk).cast("int")
    heard = F.concat(F.array_repeat(F.lit(chunk), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    both = F.transform(F.sequence(F.lit(0), F.greatest(F.size(seen), F.size(heard)) - 1), lambda j: F.concat(F.repeat(F.lit(k["video"]), F.coalesce(F.get(seen, j), F.lit(0))), F.repeat(F.lit(k["audio"]), F.coalesce(F.get(heard, j), F.lit(0)))))
    head, tail = k.get("vision_bos", "<|vision_bos|>") + k.get("audio_bos", "<|audio_bos|>"), k.get("audio_eos", "<|audio_eos|>") + k.get("vision_eos", "<|vision_eos|>")
    return F.concat(F.lit(head), F.array_join(both, ""), F.lit(tail))


def sliced_text(number: Column, rows: Column, columns: Column, with_id: bool, unit: str = "<unk>", length: int = 64) -> Column:
    """An image and its slices row by row, numbered where the format does so."""
    one = lambda tag: f"<{tag}>{unit * length}</{tag}>"
    name = F.concat(F.lit("<image_id>"), number.cast("string"), F.lit("</image_id>")) if with_id else F.lit("")
    slices = F.array_join(F.array_repeat(F.repeat(F.lit(one("slice")), columns.cast("int")), rows.cast("int")), "\n")
    return F.concat(name, F.lit(one("image")), F.when(rows * columns > 0, slices).otherwise(F.lit("")))


def cross_attention_ranges(ids: Column, image_token: int) -> Column:
    """array<struct(first, end)>: for each image mark, the positions that see it; marks in a row share their end, the last one's is -1."""
    at = F.filter(F.transform(ids, lambda x, i: F.when(x == image_token, i)), lambda i: i.isNotNull())
    n = F.size(at)

    def end(j: Column) -> Column:
        later = F.filter(F.sequence(j, n - 1), lambda x: (x == n - 1) | (F.get(at, x + 1) != F.get(at, x) + 1))
        run = F.get(later, F.lit(0))  # the last mark of the run that begins here
        return F.when(run == n - 1, F.lit(-1)).otherwise(F.get(at, run + 1))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.get(at, j).alias("first"), end(j).alias("end")))).otherwise(F.array().cast("array<struct<first:int,end:int>>"))


def cross_attention_mask(ids: Column, image_token: int, tiles: Column, most_tiles: int) -> Column:
    """array<array<array<int>>> of positions, images and tiles: 1 where a position sees a tile of an image."""
    ranges, n = cross_attention_ranges(ids, image_token), F.size(ids)
    sees = lambda p, r: (p >= r["first"]) & (p < F.when(r["end"] == -1, n).otherwise(r["end"]))
    row = lambda p: F.transform(ranges, lambda r, j: F.transform(F.sequence(F.lit(0), F.lit(most_tiles - 1)), lambda t: F.when(sees(p, r) & (t < F.get(tiles, j)), 1).otherwise(0)))
    return F.transform(ids, lambda x, p: row(p))


def wrapped(token: str, count: Column, start: str = "", end: str = "") -> Column:
    return F.concat(F.lit(start), F.repeat(F.lit(token), count.cast("int")), F.lit(end))


def token_types(ids: Column, image_token: int, kind: str, prompt_length: Column | None = None) -> Column:
    """Token type ids: paligemma marks text behind the prompt with 1, gemma marks image tokens with 1."""
    if kind == "paligemma":
        return F.transform(ids, lambda x, i: F.when(i < prompt_length, 0).otherwise(1))
    return F.transform(ids, lambda x: F.when(x == image_token, 1).otherwise(0))


def prepend_image_tokens(ids: Column, labels: Column, images: Column, length: int, image_token: int, ignore: int = -100) -> tuple[Column, Column]:
    """Image tokens in front, with ignored labels; marks in the text are stripped before."""
    n = F.size(images) * length
    return F.concat(F.array_repeat(F.lit(image_token), n), ids), F.concat(F.array_repeat(F.lit(ignore), n), labels)


Handler = Callable[[Column, dict, Column], Column]  # (metadata struct, template tokens, number of the mark) -> text


def _grid(kind: str, start: str, end: str) -> Handler:
    """All patches of a grid between two marks; a template's own marks may replace them."""
    return lambda m, k, n: wrapped(k[kind], grid_tokens(m["t"], m["h"], m["w"]), k.get("vision_bos", start), k.get("vision_eos", end))


def _counted(kind: str, name: str, start: str, end: str) -> Handler:
    return lambda m, k, n: F.concat(F.lit(f"{name} "), (n + 1).cast("string"), F.lit(":"), wrapped(k[kind], grid_tokens(m["t"], m["h"], m["w"]), start, end))


def _patches(kind: str, less: int = 0) -> Handler:
    """Patches of pixels, for each frame; less: what a default feature selection leaves out."""
    return lambda m, k, n: F.repeat(F.lit(k[kind]), ((patch_tokens(m["height"], m["width"], k.get("patch", 14), k.get("extra", 1)) * (m["frames"] if kind == "video" else 1)) - less).cast("int"))


def _next(m: Column, k: dict, n: Column) -> Column:
    return wrapped(k["image"], next_tokens(m["height"], m["width"], m["best_height"], m["best_width"], k.get("patch", 14), k.get("size", 336)))


def _gemma_image(m: Column, k: dict, n: Column) -> Column:
    """The image's fixed tokens; with crops, the image and each crop in a sentence."""
    one = "\n\n<start_of_image>" + k["image"] * k.get("length", 256) + "<end_of_image>\n\n"
    if not k.get("pan_and_scan"):
        return F.lit(one)
    return F.concat(F.lit(f"Here is the original image {one} and here are some crops to help you see better "), F.array_join(F.array_repeat(F.lit(one), m["crops"].cast("int")), " "))


def _timed(m: Column, k: dict, n: Column) -> Column:
    """Each frame's time and tokens between the vision marks."""
    frame = wrapped(k["video"], grid_tokens(1, m["h"], m["w"]), k.get("vision_bos", "<|vision_start|>"), k.get("vision_eos", "<|vision_end|>"))
    return F.array_join(frames_text(m["seconds"], m["t"], lambda t, i: F.concat(F.format_string("<%.1f seconds>", t), frame)), "")


def _frames_then_time(m: Column, k: dict, n: Column) -> Column:
    frame = wrapped(k["image"], grid_tokens(1, m["h"], m["w"]), "<|begin_of_image|>", "<|end_of_image|>")
    return F.concat(F.lit("<|begin_of_video|>"), F.array_join(frames_text(m["seconds"], m["t"], lambda t, i: F.concat(frame, t.cast("bigint").cast("string"))), ""), F.lit("<|end_of_video|>"))


def _clocked(m: Column, k: dict, n: Column) -> Column:
    frame = wrapped(k["video"], m["soft_tokens"], "<|image>", "<image|>")
    return F.array_join(F.transform(m["seconds"], lambda t: F.concat(clock(t), F.lit(" "), frame)), " ")


def _numbered_frames(m: Column, k: dict, n: Column) -> Column:
    one = lambda p, i: F.concat(F.lit("Frame"), (i + 1).cast("string"), F.lit(": "), wrapped("<IMG_CONTEXT>", F.lit(k.get("length", 256)) * p, "<img>", "</img>"))
    return F.array_join(F.transform(m["frame_patches"], one), "\n")


def _between(kind: str, start: str, end: str) -> Handler:
    return lambda m, k, n: F.lit(k.get("vision_bos", start) + k[kind] + k.get("vision_eos", end))


def _heard(tokens: Callable[[Column], Column]) -> Handler:
    return lambda m, k, n: wrapped(k["audio"], tokens(m["mel"]), k.get("audio_bos", "<|audio_bos|>"), k.get("audio_eos", "<|audio_eos|>"))


#: family -> kind of media -> text of a mark. Metadata fields: t h w (patch grid), height width (pixels), frames, seconds (times of frames), mel, and what a family names.
PLUGINS: dict[str, dict[str, Handler]] = {
    "base": {kind: (lambda m, k, n, mark=mark: F.lit(mark)) for kind, mark in (("image", IMAGE), ("video", VIDEO), ("audio", AUDIO))},
    "ernie_vl": {"image": _counted("image", "Picture", "<|IMAGE_START|>", "<|IMAGE_END|>"), "video": _counted("video", "Video", "<|VIDEO_START|>", "<|VIDEO_END|>")},
    "gemma3": {"image": _gemma_image},
    "gemma3n": {"image": _gemma_image, "audio": lambda m, k, n: F.lit("\n\n<start_of_audio>" + k["audio"] * k.get("audio_length", 188) + "<end_of_audio>\n\n")},
    "gemma4": {
        "image": lambda m, k, n: wrapped(k["image"], m["soft_tokens"], "<|image>", "<image|>"), "video": _clocked,
        "audio": lambda m, k, n: wrapped(k["audio"], m["soft_tokens"], "<|audio>", "<audio|>"),
    },
    "intern_vl": {"image": lambda m, k, n: wrapped("<IMG_CONTEXT>", F.lit(k.get("length", 256)) * m["patches"], "<img>", "</img>"), "video": _numbered_frames},
    "kimi_vl": {"image": lambda m, k, n: F.concat(F.lit("<|media_start|>image<|media_content|>"), wrapped(k["image"], grid_tokens(1, m["h"], m["w"])), F.lit("<|media_end|>"))},
    "llama4": {"image": lambda m, k, n: tiled_text(m["ratio_h"], m["ratio_w"], F.floor(F.floor(m["height"] / 14) * F.floor(m["width"] / 14) / 4).cast("int"))},
    "llava": {"image": lambda m, k, n: wrapped(k["image"], patch_tokens(m["height"], m["width"], k.get("patch", 14), k.get("extra", 0)))},
    "llava_next": {"image": _next},
    "llava_next_video": {
        "image": _next,
        "video": lambda m, k, n: F.repeat(F.lit(k["video"]), (F.floor(patch_tokens(m["height"], m["width"], k.get("patch", 14)) / 4) * m["frames"]).cast("int")),
    },
    "minicpm_v": {
        "image": lambda m, k, n: sliced_text(n, m["rows"], m["columns"], True),
        "video": lambda m, k, n: F.repeat(sliced_text(n, m["rows"], m["columns"], False), m["frames"].cast("int")),
        "audio": lambda m, k, n: wrapped("<unk>", m["soft_tokens"], "<|audio_start|>", "<|audio_end|>"),
    },
    "mllama": {"image": lambda m, k, n: F.lit(k["image"])},
    "paligemma": {"image": lambda m, k, n: F.lit("")},
    "pixtral": {"image": lambda m, k, n: pixtral_text(m["height"], m["width"], k.get("patch", 16), k["image"], k.get("break", "[IMG_BREAK]"), k.get("end", "[IMG_END]"))},
    "qwen2_audio": {"audio": _heard(audio_tokens_strided)},
    "qwen2_vl": {"image": _grid("image", "<|vision_start|>", "<|vision_end|>"), "video": _grid("video", "<|vision_start|>", "<|vision_end|>")},
    "qwen3_vl": {"image": _grid("image", "<|vision_start|>", "<|vision_end|>"), "video": _timed},
    "glm4v": {"image": lambda m, k, n: wrapped(k["image"], grid_tokens(m["t"], m["h"], m["w"]), "<|begin_of_image|>", "<|end_of_image|>"), "video": _frames_then_time},
    "qwen2_omni": {"image": _grid("image", "<|vision_bos|>", "<|vision_eos|>"), "video": _grid("video", "<|vision_bos|>", "<|vision_eos|>"), "audio": _heard(audio_tokens_strided)},
    "qwen3_omni": {"image": _grid("image", "<|vision_bos|>", "<|vision_eos|>"), "video": _grid("video", "<|vision_bos|>", "<|vision_eos|>"), "audio": _heard(audio_tokens_chunked)},
    "video_llava": {"image": _patches("image", 1), "video": _patches("video")},
    "lfm2_vl": {"image": lambda m, k, n: wrapped(k["image"], F.floor(m["h"] * m["w"] / (k.get("factor", 2) ** 2)))},
    "youtu_vl": {"image": _between("image", "<|vision_start|>", "<|vision_end|>"), "video": _between("video", "<|vision_start|>", "<|vision_end|>")},
}
#: Families that take images or videos, not both.
EXCLUSIVE = {"minicpm_v"}
MARKS = {"image": IMAGE, "video": VIDEO, "audio": AUDIO}


def register_plugin(name: str, handlers: dict[str, Handler]) -> None:
    if name in PLUGINS:
        raise ValueError(f"media plugin {name} exists")
    PLUGINS[name] = handlers


def expand_media(messages: Column, plugin: str, tokens: dict, images: Column | None = None, videos: Column | None = None, audios: Column | None = None, sound_in_video: bool = False) -> Column:
    """messages with the marks of each kind expanded in order from metadata arrays. sound_in_video: each video mark takes in the sound mark behind it."""
    given = {k: c for k, c in (("image", images), ("video", videos), ("audio", audios)) if c is not None}
    if missing := given.keys() - PLUGINS[plugin].keys():
        raise ValueError(f"media plugin {plugin} takes no {', '.join(sorted(missing))}")
    if plugin in EXCLUSIVE and {"image", "video"} <= given.keys():
        clash = (F.size(images) > 0) & (F.size(videos) > 0)
        messages = F.when(clash, F.raise_error(F.lit("images and videos don't go together here")).cast("array<struct<role:string,content:string>>")).otherwise(messages)
    if sound_in_video and {"video", "audio"} <= given.keys():
        sizes = F.when(F.size(videos) == F.size(audios), F.size(videos)).otherwise(F.raise_error(F.lit("as many videos as sounds are needed")).cast("int"))
        numbers = F.when(sizes > 0, F.sequence(F.lit(0), sizes - 1)).otherwise(F.array().cast("array<int>"))
        count = audio_tokens_chunked if plugin == "qwen3_omni" else audio_tokens_strided
        texts = F.transform(numbers, lambda i: audio_in_video(F.get(videos, i), count(F.get(audios, i)["mel"]), tokens))
        messages = expand_messages(expand_messages(messages, VIDEO, texts), AUDIO, F.array_repeat(F.lit(""), sizes))
        given.pop("video"), given.pop("audio")
    for kind, metas in given.items():
        messages = expand_messages(messages, MARKS[kind], _texts(PLUGINS[plugin][kind], metas, tokens))
    return messages


def _texts(handler: Handler, metas: Column, tokens: dict) -> Column:
    return F.transform(metas, lambda m, i: handler(m, tokens, i))


def expand_images(messages: Column, metas: Column, plugin: str, tokens: dict) -> Column:
    """messages with every image mark expanded from its metadata (array of structs, in order of the marks)."""
    return expand_media(messages, plugin, tokens, images=metas)
