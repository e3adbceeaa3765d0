"""Broken prompt and response pairs: empty, truncated, refusing, copying and foreign replies."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.runtime import cut, skew_safe_join

# Finish reasons by which a provider says that it stopped at the output cap, lower-cased.
CAP_REASONS = ("length", "max_tokens", "max_output_tokens", "model_length")

# Fixed value: the failure that stands for a refusal by the provider's safety rules.
SAFETY_REFUSAL = "response/safety_refusal"

# Refusal templates; a star stands for any few words.
REFUSALS = (
    "i cannot help with that",
    "i cannot assist with",
    "i cannot comply with this request",
    "i cannot answer",
    "i cannot provide",
    "i can't help with that",
    "i can't assist with",
    "i can't answer",
    "i can't provide",
    "i can't comply",
    "i am unable to answer",
    "i am unable to help",
    "i'm unable to answer",
    "i'm unable to help",
    "i am not able to provide",
    "i'm not able to provide",
    "i am not able to answer",
    "i'm not able to answer",
    "i'm not able to help",
    "i am not allowed to",
    "i'm not allowed to",
    "i must decline",
    "something i must decline",
    "i have to decline",
    "i decline to",
    "i must refrain from",
    "i choose not to respond",
    "i won't be answering",
    "i will not be answering",
    "i will not answer",
    "i won't answer",
    "i'd rather not say",
    "i would rather not",
    "i'm going to skip this one",
    "i will pass",
    "not something i will evaluate",
    "it isn't something i can evaluate",
    "my guidelines do not let me answer",
    "no label will be given by me",
    "no comment on this topic",
    "request declined",
    "request refused",
    "i am not permitted to",
    "i'm not permitted to",
    "beyond what i am permitted to",
    "beyond what i may",
    "this content was withheld",
    "has chosen not to respond",
    "it would be inappropriate for me to",
    "i do not feel comfortable",
    "i don't feel comfortable",
    "would not be right",
    "i can't weigh in",
    "i cannot weigh in",
    "unable to give a judgement",
    "i cannot judge",
    "i can't judge",
    "i cannot give",
    "i will not give",
    "i won't give",
    "i am not comfortable",
    "i'm not comfortable",
    "answering is outside of what i may",
    "answering this would not be responsible",
    "against the usage policy",
    "please ask about something else",
    "please consult a qualified expert",
)

# Frequent words of languages; English last, as the one that is expected.
LANGUAGE_WORDS = {
    "fr": "le la les un une des du de et est dans que qui pour avec sans sur par ne pas plus ce cette ces aux son sa oui non donc vers après selon être serait chiffres effet",
    "de": "der die das ein eine einen und ist in den dem des mit ohne von zu nicht auf für als auch wird ja nein daher nach zeigt sich keinen wäre ergebnis zahlen",
    "es": "el la los las un una y es en que de del con sin por para no sí se según tras eso más lo muestra habría datos grupo ningún efecto",
    "pt": "o a os as um uma e é em que de do da dos das com sem por para não sim se depois maior taxa mais teria portanto números efeito grupo",
    "it": "il lo la gli le un una e è in che di del della con senza per non sì si dopo più dati quindi gruppo effetto sarebbe",
    "nl": "de het een en is in van met zonder niet op voor dat die deze dus ja nee hoor klopt na wel hoger geen groep effect cijfers zou pad",
    "pl": "i w z na do nie tak jest bez po od że się to więc ma dane grupa wyższy niż nie nie ta ten grafie ścieżki efekt dla wynik",
    "id": "yang dan di ke dari menjadi bahwa ini itu dengan tanpa untuk tidak ya adalah akan oleh karena pada lebih daripada kelompok setelah tersebut jalur efeknya",
    "sv": "och är att det en ett inte med utan för på som av ja nej därför efter gruppen",
    "da": "og er at det en et ikke med uden for på som af ja nej derfor efter gruppen",
    "tr": "ve bir bu için ile değil evet hayır olmadan göre daha sonra grup etkisi",
    "ro": "și este un o în că de cu fără nu da pe mai după deci grupul efectul",
    "cs": "a je v na že ne ano bez po od se to tedy skupina účinek",
    "fi": "ja on ei että se kyllä ilman jälkeen ryhmä vaikutus",
    "en": "the a an of to and is in that for with without on by not would be are it as at this from which was or no yes so than more only case i you we what there does have has if its can same will one any into but since both other me my do",
}
# Words of the lists above that English has too; they alone never tell a language.
ENGLISH_TOO = frozenset("a an and as at con data den die dig do effect en for i in is me men met no of on op over pad pas per plus pour sans sin so son ten van was wel".split())
#: Other words that speak for a language in a reply of more than SHORT_REPLY words.
EVIDENCE, SHORT_REPLY = 2, 3
_LANGUAGE_SETS = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}

SHINGLE = 3
COPY_OF_REPLY = 0.75
COPY_OF_QUESTION = 0.5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LABEL = re.compile(r"(?:final\s+answer|answer|label|decision)?\W*\b(?:yes|no)\b\W*", re.I)
_OPENING = re.compile(r"\W*(?:yes|no)\b\s*(?:[,;:.!—–-]|$)", re.I)
_STATED = re.compile(r"(?:final answer|the answer is|answer)\s*[:=]?\s*\W?(?:yes|no)\b", re.I)
#: A final label after a finished sentence on the same line.
_INLINE = re.compile(r"[.!?:;]\s+[*_\"'(]*(?:YES|NO)[*_\"').!]*\s*$")
_REFUSED = re.compile(r"(?:^|[.!?]\s)\W*refused\W*$", re.I)
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|(?<!\w)['‘][^'’]*['’](?!\w)")
_TAG = re.compile(r"<(/?)(\w+)[^<>]*>")
_ENDS = tuple(".!?…。！？．｡)]}\"'”’»`*_")
#: A number cut at its decimal point is no end of a sentence.
_CUT_NUMBER = re.compile(r"(?<![\d.,])0\.$")


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def unwrap(raw: str) -> tuple[str, object, bool]:
    """(content without fences and tags, decoded JSON or None, whether a wrapper was opened but not closed)."""
    text, broken = raw.strip().strip("﻿​"), False
    if text.startswith("```"):
        body = re.sub(r"^```\w*", "", text)
        if body.rstrip().endswith("```"):
            body = body.rstrip()[:-3]
        else:
            broken = any(c.isalnum() for c in body)
        text = body.strip()
    open_tags = [m.group(2) for m in _TAG.finditer(text) if not m.group(1)]
    if open_tags:
        if text.startswith("<") and f"</{open_tags[0]}>" not in text:
            broken = True
        text = _TAG.sub(" ", text).strip()
    decoded = None
    if text[:1] in ("{", "["):
        try:
            decoded = json.loads(text, strict=False)
        except ValueError:
            broken = broken or text[:2] in ('{"', "{\n", "{ ", "[{", '["', "{") or text == "{"
    elif text[:1] == '"' and text[-1:] == '"':
        try:
            decoded = json.loads(text, strict=False)
        except ValueError:
            pass
    return text, decoded, broken


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def _shingles(tokens: list[str]) -> Counter:
    return Counter(tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1))


def _plain(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


def copies_question(reply: list[str], question: list[str], given: list[str]) -> bool:
    """Whether the reply holds little but the question, with or without the given text.

    Reply and prompt are aligned in both field orders, and with the question said again and again: most of the reply must be covered by the longest common
    subsequence and by shared shingles or words, and a good part of the question must be there.
    """
    if not reply or not question:
        return False
    for drop in (0, 1):  # a leading word such as "Question:" is no addition
        r = reply[drop:] if drop == 0 or reply[0] in ("question", "prompt", "q", "item") else []
        times = -(-len(r) // len(question))
        if not r:
            continue
        asked = _lcs(question, r) / len(question)
        if asked < COPY_OF_QUESTION:
            continue
        covered = max(_lcs(r, given + question), _lcs(r, question + given), _lcs(r, question * times)) / len(r)
        if covered < COPY_OF_REPLY:
            continue
        own, prompt = _shingles(r), _shingles(given + question * times) + _shingles(question + given)
        shared = sum((own & prompt).values()) / max(1, sum(own.values()))
        if shared >= 0.3 or covered >= 0.9:
            return True
    return False


_TEMPLATES = [_plain(t) for t in REFUSALS]


def refuses(reply: list[str]) -> bool:
    """Whether a refusal template aligns with the reply: all its words but one in five, in order, with few words between."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(reply):
        places.setdefault(w, []).append(i)
    for t in _TEMPLATES:
        if sum(w in places for w in t) < len(t) - len(t) // 5:
            continue
        span = len(t) + len(t) // 4
        starts = {max(0, i - k) for k, w in enumerate(t[: 1 + len(t) // 5]) for i in places.get(w, ())}
        for s in starts:
            if _lcs(t, reply[s : s + span]) >= len(t) - len(t) // 5:
                return True
    return False


_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _name, _set in _LANGUAGE_SETS.items():
    for _w in _set:
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _name)
_LETTERS = re.compile(r"[^\W\d_]+")


def foreign(text: str) -> bool:
    """Whether text, its quoted phrases and label lines aside, is in another language than English.

    So it is if over three in ten letters are not Latin, or if some other language's frequent words, together
    with words that have letters beyond ASCII, outnumber the English ones. Words that English has too do not
    suffice, and beyond a few words a single one does not either.
    """
    text = _QUOTED.sub(" ", text)
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        other = sum(ord(c) > 127 and not unicodedata.name(c, "LATIN").startswith("LATIN") for c in letters)
        if letters and other > 0.3 * len(letters):
            return True
    if "\n" in text:
        text = "\n".join(x for x in text.splitlines() if not _LABEL.fullmatch(x.strip()))
    scores = dict.fromkeys(_LANGUAGE_SETS, 0)
    told: dict[str, set[str]] = {k: set() for k in _LANGUAGE_SETS}
    marked, words = 0, _LETTERS.findall(text.lower())
    for w in words:
        for language in _LANGUAGES_OF.get(w, ()):
            scores[language] += 1
            if w not in ENGLISH_TOO:
                told[language].add(w)
        marked += not w.isascii()
    english = scores.pop("en")
    best, need = max(scores.values()), EVIDENCE if len(words) > SHORT_REPLY else 1
    if best > english:
        return any(scores[k] == best and told[k] and (len(told[k]) + marked >= need or best >= english + 3) for k in scores)
    return marked > 0 and best >= 1 and best + marked > english


def screen(raw: str | None, parsed: str | None = None, failure: str | None = None) -> tuple[str | None, str | None]:
    """(defect, reply) as far as the reply alone tells; reply is its readable content if it may yet be a copy of its question.

    parsed is the label that the run read from it: with YES or NO it answers, whatever its form. failure is what the
    run recorded: a provider's safety refusal makes a reply without an answer a refusal.
    """
    if raw is None:
        return "empty", None
    if _LABEL.fullmatch(raw.strip()):
        return None, None
    content, decoded, broken = unwrap(raw)
    body = content if decoded is None else "\n".join(p for p in _strings(decoded) if p)
    if not broken and not any(c.isalnum() for c in body) and not (decoded is not None and _scalar(decoded)):
        return "empty", None
    if broken:
        return "truncated", None
    if (parsed or "").strip().upper() in ("YES", "NO") or _answers(content, decoded):
        return ("other_language" if foreign(body) else None), None
    end = body.rstrip()
    if (failure or "").strip().lower() == SAFETY_REFUSAL or (isinstance(decoded, dict) and "refusal" in decoded) or refuses(_plain(body)) or _REFUSED.search(body):
        return "refusal", body
    if foreign(body):
        return "other_language", body
    if decoded is None and (not end.endswith(_ENDS) or _CUT_NUMBER.search(end)):
        return "truncated", body
    return None, body


def defect(raw: str | None, finish: str | None, question: str | None, given: str | None, parsed: str | None = None, failure: str | None = None) -> str | None:
    """The defect of a reply, or None; of several the first of empty, truncated by the cap or a wrapper left open,
    copied_question, refusal, other_language, truncated in mid-sentence."""
    found, reply = screen(raw, parsed, failure)
    if found != "empty" and (finish or "").strip().lower() in CAP_REASONS:
        return "truncated"
    if reply is not None and copies_question(_plain(reply), _plain(question or ""), _plain(given or "")):
        return "copied_question"
    return found


def _scalar(value: object) -> bool:
    """Whether decoded JSON holds a number or a truth value, which is content without letters."""
    if isinstance(value, dict):
        return any(_scalar(v) for v in value.values())
    if isinstance(value, list):
        return any(_scalar(v) for v in value)
    return isinstance(value, bool | int | float)


def _answers(content: str, decoded: object) -> bool:
    """Whether an English YES or NO is given as the answer."""
    if isinstance(decoded, dict):
        return any(isinstance(v, str) and _LABEL.fullmatch(v.strip()) is not None for v in decoded.values()) or any(isinstance(v, bool) for v in decoded.values())
    lines = [x.strip() for x in content.splitlines() if x.strip()]
    if not lines:
        return False
    return bool(_LABEL.fullmatch(lines[-1]) or _INLINE.search(lines[-1]) or _OPENING.match(lines[0]) or _STATED.search(content))


def _screen_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [screen(*x) for x in zip(batch["raw_output"], batch["parsed_answer"], batch["failure_type"], strict=True)]
        yield batch.drop(columns=["raw_output", "parsed_answer", "failure_type"]).assign(found=[d for d, _ in done], reply=[r for _, r in done])


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = [copies_question(_plain(r), _plain(q or ""), _plain(g or "")) for r, q, g in zip(batch["reply"], batch["question"], batch["given_info"], strict=True)]
        yield batch.loc[same, ["call_id", "attempt_index"]]


def capped_attempts(calls: DataFrame) -> DataFrame:
    """(call_id, attempt_index) of every attempt that its provider stopped at the output cap: failed attempts from
    retry_events, the last attempt of a successful call from the call's own columns."""
    last = calls.filter("status = 'success'").select("call_id", "attempt_index", "finish_reason")
    failed = calls.select("call_id", F.explode("retry_events").alias("e")).select("call_id", "e.attempt_index", "e.finish_reason")
    return last.unionByName(failed).filter(F.lower(F.trim("finish_reason")).isin(*CAP_REASONS)).select("call_id", "attempt_index").distinct()


def broken_pairs(attempts: DataFrame, calls: DataFrame, items: DataFrame) -> DataFrame:
    """(call_id, attempt_index, defect_type) of every defective attempt with http_status 200, once each.

    Replies are screened where they are read; only replies that give no answer go on to be aligned with their
    item's question, and only keys are shuffled to meet the finish reasons. A null reply is empty. An attempt whose
    item is unknown cannot be a copy; one whose call is unknown has no finish reason. Of two deliveries of one
    attempt the later one counts. parsed_answer and failure_type are used where the attempts have them. Items: item_id, given_info, question; repeated items count once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema.fields}
    recorded = [F.col(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in ("parsed_answer", "failure_type")]
    read = attempts.filter("http_status = 200").select("call_id", "attempt_index", "item_id", "ingested_at", "raw_output", *recorded)
    layout = ", ".join(f"{c} {kinds[c]}" for c in ("call_id", "attempt_index", "item_id", "ingested_at"))
    screened = read.mapInPandas(_screen_batches, f"{layout}, found string, reply string")
    later = F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), "found", "item_id", "reply")
    latest = screened.groupBy("call_id", "attempt_index").agg(F.max(later).alias("l"))
    capped = capped_attempts(calls).withColumn("capped", F.lit(True))
    judged = cut(
        latest.join(capped, ["call_id", "attempt_index"], "left")
        .select("call_id", "attempt_index", "l.item_id", "l.reply", F.when(F.col("capped") & ~F.col("l.found").eqNullSafe("empty"), "truncated").otherwise(F.col("l.found")).alias("found"), "capped")
        .filter("found is not null or reply is not null")
    )
    open_rows = judged.filter("reply is not null and capped is null and item_id is not null").select("call_id", "attempt_index", "item_id", "reply")
    counts = cut(open_rows.groupBy("item_id").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).head()["t"]
    asked = items.select("item_id", "given_info", "question").join(counts, "item_id").groupBy("item_id").agg(F.min(F.struct("question", "given_info")).alias("q"), F.first("n").alias("n"))
    asked = asked.select("item_id", "q.question", "q.given_info", "n")
    copies = skew_safe_join(open_rows, asked, ["item_id"], "n", total).mapInPandas(_copy_batches, f"call_id {kinds['call_id']}, attempt_index {kinds['attempt_index']}")
    joined = judged.join(copies.withColumn("copied", F.lit(True)), ["call_id", "attempt_index"], "left")
    return joined.select("call_id", "attempt_index", F.when(F.col("copied"), "copied_question").otherwise(F.col("found")).alias("defect_type")).filter("defect_type is not null")
