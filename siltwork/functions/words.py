"""Key-word and subject/action/object/status extraction from short English log messages.

Dictionaries are closed over by an Arrow batch function; the Chinese part-of-speech tagger has no
counterpart here, so Chinese words are found by dictionary only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from siltwork.functions.types import TEXTUAL, Field

_STOP = frozenset("the a an to of in on at for with and or is was are were be been by from as it this that has have had not no".split())
_STATUS = frozenset("failed failure success successful succeeded error timeout exception denied refused rejected ok lost down up warning critical expired unavailable completed aborted".split())
_ACTIONS = frozenset("connect disconnect start stop open close read write send receive login logout create delete update load save execute query request respond restart retry fetch parse bind listen accept".split())
_ENTITIES = frozenset("database server connection network file user service system disk memory process thread socket port host client session request response cache queue table config application api".split())


@dataclass
class Dictionary:
    """``add`` to or ``replace`` the built-in words; a disabled dictionary extracts nothing."""

    enabled: bool = True
    stop_words: frozenset = _STOP
    status_words: frozenset = _STATUS
    action_verbs: frozenset = _ACTIONS
    entity_nouns: frozenset = _ENTITIES
    domain_words: frozenset = field(default_factory=frozenset)

    @classmethod
    def of(cls, config: dict) -> "Dictionary":
        if config.get("version", 1) != 1:
            raise ValueError("semantic dictionary version must be 1")
        replace = config.get("mode", "add") == "replace"
        base = cls()
        words = {k: frozenset(w.lower() for w in config.get(k, ())) for k in ("stop_words", "status_words", "action_verbs", "entity_nouns", "domain_words")}
        return cls(bool(config.get("enabled", True)), **{k: w if replace else w | getattr(base, k) for k, w in words.items()})


def load_dictionary(path: str) -> Dictionary:
    """A dictionary from a TOML file with version, mode, enabled and word lists, on the driver."""
    import tomllib

    with open(path, "rb") as f:
        return Dictionary.of(tomllib.load(f))


def _stem(word: str) -> str:
    for end, least in (("ing", 4), ("ed", 3)):
        if word.endswith(end) and len(word) > least:
            return word[: -len(end)]
    return word


def classify(word: str, d: Dictionary) -> str | None:
    w = word.lower()
    if w in d.stop_words:
        return None
    if w in d.status_words:
        return "status"
    if w in d.action_verbs or _stem(w) in d.action_verbs or _stem(w) + "e" in d.action_verbs:
        return "action"
    if w in d.entity_nouns or w in d.domain_words or (w.endswith("s") and w[:-1] in d.entity_nouns):
        return "entity"
    if w.endswith(("tion", "sion")) and len(w) > 5:
        return "entity"
    if w.endswith("ing") and len(w) > 4 or w.endswith("ed") and len(w) > 3:
        return "action"
    return "noun" if w.isalpha() else None


def main_word(text: str, d: Dictionary) -> str:
    for word in re.findall(r"\w+", text):
        if word.lower() in d.domain_words or classify(word, d):
            return word
    return ""


def parts(text: str, d: Dictionary) -> dict[str, str]:
    out = {"subject": "", "action": "", "object": "", "status": ""}
    for word in re.findall(r"\w+", text):
        kind = classify(word, d)
        if kind == "status" and not out["status"]:
            out["status"] = word
        elif kind == "action" and not out["action"]:
            out["action"] = word
        elif kind in ("entity", "noun"):
            slot = "object" if out["action"] and (out["subject"] or kind == "entity") else "subject"
            if slot == "object" and not out["subject"]:
                slot = "object"
            if not out[slot]:
                out[slot] = word
    if out["subject"] == "" and out["object"]:
        out["subject"], out["object"] = out["object"], ""
    return out


def extract_main_word(f: Field, dictionary: Dictionary | None = None) -> Field:
    if f.kind not in TEXTUAL:
        return f
    d = dictionary or Dictionary()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else main_word(x, d) if d.enabled else "")

    return Field(run(f.column), "chars")


def extract_subject_object(f: Field, dictionary: Dictionary | None = None) -> Field:
    if f.kind not in TEXTUAL:
        return f
    d = dictionary or Dictionary()

    @F.pandas_udf("subject string, action string, object string, status string")
    def run(values: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("subject", "action", "object", "status"), "")
        return pd.DataFrame([empty if x is None or not d.enabled else parts(x, d) for x in values], columns=list(empty))

    return Field(F.when(f.column.isNotNull(), run(f.column)), "obj")
