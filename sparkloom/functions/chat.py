"""Chat rows: flattening turns, metadata rules, domains. Column expressions over rows with any of the usual fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of roles; other roles are capitalised.
ROLE_LABELS = {
    "system": "System",
    "user": "User",
    "human": "User",
    "assistant": "Assistant",
    "gpt": "Assistant",
    "bot": "Assistant",
    "model": "Assistant",
    "tool": "Tool",
    "function": "Tool",
}

# What each source drops, before any language filter; all comparisons without case.
EXCLUSION = {
    "tulu-v2": {},
    "openhermes-25": {"languages": ["en", "eng", "english"]},
    "tulu-3": {"source": ["wildguardmix", "wildjailbreak", "coconot", "tulu-3-sft-personas-instruction-following", "aya"]},
    "hermes-3": {},
    "smoltalk": {"configs": ["apigen-80k", "smol-constraints"]},
    "dolci": {"domains": ["safety", "precise if"], "source_dataset": ["coconot", "aya", "wildguard", "wildjailbreak", "tool use"], "function_calls": True},
}

# The names of those rules in a file of rules.
RULE_KEYS = {
    "source": "drop_source_substrings",
    "languages": "english_language_values",
    "configs": "skip_configs",
    "domains": "drop_domains",
    "source_dataset": "drop_source_dataset_substrings",
}

# Domains by source; of substrings the first that fits decides.
CONFIG_DOMAIN = {
    "numina-cot-100k": "math",
    "metamathqa-50k": "math",
    "self-oss-instruct": "code",
    "everyday-conversations": "chat",
    "systemchats-30k": "chat",
    "smol-magpie-ultra": "chat",
    "openhermes-100k": "general",
    "smol-summarize": "general",
    "smol-rewrite": "general",
    "explore-instruct-rewriting": "general",
    "longalign": "general",
}
SUBSTRING_DOMAIN = {
    "tulu-3": [
        ("personas-math", "math"), ("personas_math", "math"), ("math-grade", "math"), ("personas-algebra", "math"), ("personas_algebra", "math"), ("numina", "math"),
        ("personas-code", "code"), ("personas_code", "code"), ("evol-codealpaca", "code"), ("codealpaca", "code"), ("sciriff", "science"),
        ("wildchat", "chat"), ("no_robots", "chat"), ("no-robots", "chat"), ("oasst", "chat"),
        ("flan", "general"), ("table-gpt", "general"), ("tablegpt", "general"), ("hard-coded", "general"), ("hard_coded", "general"),
    ],
    "tulu-v2": [
        ("code_alpaca", "code"), ("codealpaca", "code"), ("science", "science"), ("sharegpt", "chat"), ("hard_coded", "chat"), ("cot", "general"),
        ("flan", "general"), ("open_orca", "general"), ("gpt4_alpaca", "general"), ("wizardlm", "general"), ("lima", "general"),
    ],
    "openhermes-25": [("math", "math"), ("code", "code"), ("coding", "code"), ("science", "science"), ("roleplay", "chat"), ("general", "general")],
    "dolci": [("math", "math"), ("science", "science"), ("code", "code"), ("python", "code"), ("coding", "code"), ("wildchat", "chat"), ("chat", "chat")],
}
EXACT_DOMAIN = {"math": "math", "science": "science", "coding": "code", "code": "code", "chat": "chat", "other": "general", "general": "general"}


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def role_label(role: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(role, F.lit("user"))))
    table = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    other = F.when(key == "", "User").otherwise(F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 30)))
    return F.coalesce(F.try_element_at(table, key), other)


def content_text(content: Column) -> Column:
    """A message's content as text: plain text as it is; a JSON list of parts as its texts, one a line; a JSON object as
    its text or content; null as nothing."""
    v = F.try_parse_json(content)
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$.content", "string"))
    parts = F.from_json(content, "array<string>")
    texts = F.filter(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.when(~p.startswith("{"), p))), lambda x: F.coalesce(x, F.lit("")) != "")
    start = F.substring(F.trim(content), 1, 1)
    listed, held = (start == "[") & v.isNotNull() & parts.isNotNull(), (start == "{") & v.isNotNull()
    return F.coalesce(F.when(listed, F.array_join(texts, "\n")).when(held, F.coalesce(one(v), F.lit(""))).otherwise(content), F.lit(""))


def english(df: DataFrame, scores: str = "attributes", name: str = "en", least: float = 0.5) -> Column:
    """Whether a tagger's score (a map of scores by name) reaches `least`; rows without one are left out."""
    return F.coalesce(F.try_element_at(F.col(scores), F.lit(name)) >= least, F.lit(False))


def flatten_turns(turns: Column) -> Column:
    """array<struct<role, content>> -> 'Label: content' joined by blank lines; turns without content are left out."""
    kept = F.filter(turns, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(role_label(m["role"]), F.lit(": "), F.trim(m["content"]))), "\n\n")


def flatten_rows(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation from one row a turn."""
    each = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("turns"))
    return listed.select(key, F.size("turns").cast("long").alias("n_turns"), flatten_turns(F.col("turns")).alias("text"))


def _any_of(hay: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(hay, n)) if needles else F.lit(False)


def holds_call(field: Column, kind: T.DataType) -> Column:
    """Whether a tool field of a message holds something: a text that isn't blank, a list or map that isn't empty, a JSON
    list or object (as text or variant) that isn't, or any other value. Null holds nothing."""
    if isinstance(kind, T.StringType):
        return F.coalesce(~F.regexp_replace(field, r"\s", "").isin("", "[]", "{}", "null"), F.lit(False))
    if isinstance(kind, T.VariantType):
        return holds_call(F.try_variant_get(field, "$", "string"), T.StringType())
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(field) > 0, F.lit(False))
    return field.isNotNull()


def load_rules(spark, path: str) -> dict[str, dict]:
    """Exclusion rules of a YAML file, for keep_row: a top-level map `sources` with an entry for each known source. Another
    form, an unknown source or a missing one raises."""
    import yaml

    raw = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # a configuration file
    if not isinstance(raw, dict) or not isinstance(raw.get("sources"), dict):
        raise ValueError(f"{path} has no map of sources")
    given = raw["sources"]
    if unlike := sorted(set(given) ^ set(EXCLUSION)):
        raise ValueError(f"{path}: sources that are missing or unknown: {', '.join(unlike)}")
    rules = {}
    for source, own in given.items():
        own = own or {}
        if not isinstance(own, dict):
            raise ValueError(f"{path}: {source} isn't a map")
        rule: dict = {}
        for name, key in RULE_KEYS.items():
            listed = own.get(key) or []
            if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
                raise ValueError(f"{path}: {key} of {source} isn't a list of texts")
            if listed:
                rule[name] = [x.strip().lower() for x in listed]
        if own.get("drop_non_english_language"):
            rule.setdefault("languages", EXCLUSION["openhermes-25"]["languages"])
        else:
            rule.pop("languages", None)
        if own.get("drop_if_function_calls"):
            rule["function_calls"] = True
        rules[source] = rule
    return rules


def keep_row(df: DataFrame, source: str, rules: dict[str, dict] | None = None) -> Column:
    """Whether a source's rule keeps a row; an unknown source raises. rules: those of load_rules in place of EXCLUSION."""
    rules = EXCLUSION if rules is None else rules
    if source not in rules:
        raise ValueError(f"unknown source: {source!r}")
    rule = rules[source]
    low = lambda *names: F.concat_ws(" ", *[F.when(F.trim(_field(df, n)) != "", F.lower(F.trim(_field(df, n)))) for n in names])
    if "configs" in rule:
        return ~F.coalesce(F.lower(F.trim(_field(df, "config"))).isin(rule["configs"]), F.lit(False))
    keep = F.lit(True)
    if "languages" in rule:
        lang = F.lower(F.trim(_field(df, "language")))
        keep = lang.isNull() | (lang == "") | lang.isin(rule["languages"])
    if source == "tulu-3":
        return ~_any_of(low("source", "id"), rule.get("source", []))
    if source == "dolci":
        keep = ~F.coalesce(F.lower(F.trim(_field(df, "domain"))).isin(rule.get("domains", [])), F.lit(False)) & ~_any_of(low("source_dataset", "id"), rule.get("source_dataset", []))
        turns = next((c for c in ("messages", "conversations") if c in df.columns), None)
        if rule.get("function_calls") and turns:
            kinds = {f.name: f.dataType for f in df.schema[turns].dataType.elementType.fields if f.name in ("function_calls", "functions")}
            called = lambda m: reduce(lambda a, b: a | b, [holds_call(m[n], kind) for n, kind in kinds.items()], F.lit(False))
            keep = keep & ~F.coalesce(F.exists(turns, called), F.lit(False))
        return keep
    return keep & ~_any_of(low("source", "dataset", "source_dataset", "id"), rule.get("source", []))


def map_domain(df: DataFrame, source: str) -> Column:
    """The domain label of a row; 'general' if no rule fits; an unknown source raises."""
    if source not in EXCLUSION:
        raise ValueError(f"unknown source: {source!r}")
    if source == "smoltalk":
        config = F.lower(F.trim(F.coalesce(_field(df, "config"), _field(df, "source"))))
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIG_DOMAIN.items() for x in kv]), config), F.lit("general"))
    fields = {"tulu-3": ("source", "id"), "tulu-v2": ("dataset", "source", "id"), "dolci": ("source_dataset",)}.get(source, ())
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(_field(df, f), F.lit("")) for f in fields]))
    if source == "openhermes-25":
        hay = F.lower(F.coalesce(F.when(_field(df, "category") != "", _field(df, "category")), _field(df, "source"), F.lit("")))
    out = F.lit("general")
    for needle, domain in reversed(SUBSTRING_DOMAIN.get(source, [])):
        out = F.when(F.contains(hay, F.lit(needle)), domain).otherwise(out)
    if source == "dolci":
        exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXACT_DOMAIN.items() for x in kv]), F.lower(F.trim(F.coalesce(_field(df, "domain"), F.lit("")))))
        out = F.coalesce(exact, out)
    return out


def row_id(df: DataFrame, source: str, index: Column, config: str | None = None) -> Column:
    """source[:config]:id from the first of id, uuid and conversation_id that isn't blank, else the row's index."""
    own = F.coalesce(*[F.when(F.trim(_field(df, k)) != "", F.trim(_field(df, k))) for k in ("id", "uuid", "conversation_id")])
    named = F.concat(F.lit(f"{source}:{config}:" if config else f"{source}:"), own)
    return F.coalesce(named, F.concat(F.lit(f"{source}:{config}-" if config else f"{source}:"), index.cast("string")))
