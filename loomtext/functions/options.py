"""What users write for lengths, durations, languages and models, as Columns.

An option that does not parse gives null; callers decide whether that is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Summary presets: most, target and least characters and token limit; fixed values.
PRESETS = {"short": (1200, 900, 600, 768), "medium": (2500, 1800, 1200, 1536), "long": (6000, 4200, 2500, 3072), "xl": (14000, 9000, 6000, 6144), "xxl": (22000, 17000, 14000, 12288)}
LEAST_CHARS, LEAST_TOKENS = 50, 16
PROVIDERS = ("xai", "openai", "google", "anthropic", "zai", "nvidia")
#: Languages by name and tag, fixed values of the common ones.
LANGUAGES = {"en": "English", "de": "German", "es": "Spanish", "fr": "French", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "pl": "Polish", "cs": "Czech", "tr": "Turkish", "ru": "Russian", "uk": "Ukrainian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi"}


def _choice(raw: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.lower(F.trim(raw))]


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def mode(raw: Column, option: str) -> Column:
    """The canonical value of an option of a fixed set."""
    sets = {
        "youtube": _same("auto", "web", "apify", "yt-dlp", "no-auto") | {"autp": "auto"}, "scrape": _same("off", "auto", "always"), "markdown": _same("off", "auto", "llm", "readability"),
        "format": {"text": "text", "txt": "text", "plain": "text", "md": "markdown", "markdown": "markdown"}, "preprocess": _same("off", "auto", "always") | {"on": "always"},
        "stream": _same("auto", "on", "off"), "metrics": _same("off", "on", "detailed"), "video": _same("auto", "transcript", "understand"),
    }
    return _choice(raw, sets[option])


def boolean(raw: Column) -> Column:
    plain = F.lower(F.trim(raw))
    return F.when(plain.isin("1", "true", "yes", "on"), True).when(plain.isin("0", "false", "no", "off"), False)


def duration_ms(raw: Column) -> Column:
    """A number with ms, s, m or h (s if none), positive."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)?\s*\z"
    n = F.regexp_extract(raw, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    times = F.when(unit == "ms", 1).when(unit == "m", 60_000).when(unit == "h", 3_600_000).otherwise(1000)
    return F.when(n > 0, F.floor(n * times).cast("long"))


def count(raw: Column, least: int) -> Column:
    """A number with k or m, positive and not under ``least``."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(k|m)?\s*\z"
    n = F.regexp_extract(raw, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    total = F.floor(n * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).cast("long")
    return F.when((n > 0) & (total >= least), total)


def length(raw: Column) -> Column:
    """struct(kind, preset, chars): a preset by name or letter, or a number of characters."""
    preset = _choice(raw, _same(*PRESETS) | {"s": "short", "m": "medium", "l": "long"})
    chars = count(raw, LEAST_CHARS)
    none = F.lit(None)
    return F.when(preset.isNotNull(), F.struct(F.lit("preset").alias("kind"), preset.alias("preset"), none.cast("long").alias("chars"))).when(chars.isNotNull(), F.struct(F.lit("chars").alias("kind"), none.cast("string").alias("preset"), chars.alias("chars")))


def retries(raw: Column, most: int = 5) -> Column:
    n = F.trim(raw).try_cast("double")
    return F.when((n == F.floor(n)) & n.between(0, most), n.cast("int"))


def preset_for(chars: Column) -> Column:
    out = F.lit("xxl")
    for name in ("xl", "long", "medium", "short"):
        out = F.when(chars <= PRESETS[name][0], name).otherwise(out)
    return out


def language(raw: Column) -> Column:
    """struct(kind, tag, label): auto, a known language, a tag, or up to 64 free characters."""
    plain = F.trim(raw)
    compact = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-"), "^-|-$", "")
    tags = _same(*LANGUAGES) | {name.lower(): tag for tag, name in LANGUAGES.items()}
    tag = F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))[compact]
    label = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[tag]
    parts = F.split(F.translate(plain, "_", "-"), "-")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(F.length(p) == 2, F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
    cased = F.array_join(F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), tail), "-")
    free = F.substring(F.regexp_replace(plain, r"\s+", " "), 1, 64)
    fixed = lambda t, l: F.struct(F.lit("fixed").alias("kind"), t.alias("tag"), l.alias("label"))  # noqa: E731, E741
    auto = F.struct(F.lit("auto").alias("kind"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("label"))
    return F.when(F.coalesce(compact, F.lit("")).isin("", "auto"), auto).when(tag.isNotNull(), fixed(tag, label)).when(plain.rlike(r"^[a-zA-Z]{2,3}([_-][a-zA-Z0-9]{2,8})*\z"), fixed(cased, cased)).otherwise(fixed(free, free))


def model_id(raw: Column) -> Column:
    """``provider/model``; the provider is inferred from the name if there is none, null if unknown."""
    plain = F.trim(raw)
    low = F.lower(plain)
    fast = low.rlike(r"^(xai/)?grok-4[-.]1-fast-non-reasoning\z")
    short = F.regexp_extract(low, r"^(?:anthropic/)?(claude-(?:sonnet|opus)-4)\z", 1)
    provider = F.split_part(low, F.lit("/"), F.lit(1))
    model = F.regexp_extract(plain, r"^[^/]*/(.*)\z", 1)
    bare = F.concat(F.when(low.rlike("^grok-"), "xai/").when(low.rlike("^gemini-"), "google/").when(low.rlike("^claude-"), "anthropic/").otherwise("openai/"), plain)
    out = F.when(plain == "", None).when(fast, "xai/grok-4-fast-non-reasoning").when(short != "", F.concat(F.lit("anthropic/"), short, F.lit("-0")))
    return out.when(~F.contains(plain, F.lit("/")), bare).when(provider.isin(*PROVIDERS) & (F.trim(model) != ""), F.concat(provider, F.lit("/"), model))


def required_key(model: Column) -> Column:
    """Name of the key that a model needs."""
    low = F.lower(model)
    names = {"openrouter": "OPENROUTER_API_KEY", "xai": "XAI_API_KEY", "google": "GEMINI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "zai": "Z_AI_API_KEY", "nvidia": "NVIDIA_API_KEY"}
    out = F.lit("OPENAI_API_KEY")
    for name, key in names.items():
        out = F.when(F.startswith(low, F.lit(f"{name}/")), key).otherwise(out)
    return F.when(F.startswith(low, F.lit("cli/")), F.concat(F.lit("CLI_"), F.upper(F.split_part(low, F.lit("/"), F.lit(2))))).otherwise(out)


def effort(raw: Column) -> Column:
    return _choice(raw, _same("none", "minimal", "low", "medium", "high", "xhigh") | {"off": "none", "min": "minimal", "mid": "medium", "max": "xhigh"})


def tier(raw: Column) -> Column:
    return F.nullif(_choice(raw, _same("default", "auto", "flex", "priority") | {"fast": "priority"}), F.lit("default"))


def merged(*layers: Column) -> Column:
    """The last of the layers that says anything."""
    return F.coalesce(*reversed(layers))


def instructions(base: Column, override: Column, required: Column, length_: Column, language_: Column) -> Column:
    """Lines: the override or the base, what is required, length, language; blank ones left out."""
    head = F.coalesce(F.nullif(F.trim(override), F.lit("")), F.trim(base))
    lines = F.concat(F.array(head), F.transform(F.coalesce(required, F.array().cast("array<string>")), lambda x: F.trim(x)), F.array(F.trim(length_), F.trim(language_)))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n")


def tagged_prompt(instructions_: Column, context: Column, content: Column) -> Column:
    part = lambda tag, body: F.concat(F.lit(f"<{tag}>\n"), F.coalesce(body, F.lit("")), F.lit(f"\n</{tag}>"))
    return F.concat(part("instructions", F.trim(instructions_)), F.lit("\n\n"), part("context", F.trim(context)), F.lit("\n\n"), part("content", content), F.lit("\n"))
