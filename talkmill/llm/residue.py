"""Template residue, filler, error pages and scripts-required notices.

A text is cut into messages (lines and sentences). Each message is normalised and masked: numbers, addresses and dates become
marks, unfilled placeholders become a slot mark, stray signs inside words go. Equal messages are grouped by the hash of their
masked form over all documents and sources. Each distinct message is then judged once, from how widely it recurs and from
placeholder and phrase rules: each rule is a notion (scripts, switching something on, parts of the web, failure, filler, a
narrator's voice, ...) with its words in several languages, or a measure (words that repeat, words unlike any language). A
message that meets a telling rule is a candidate; a logistic regression over the rules and the recurrence, fitted to the
labelled messages of `residue_examples`, decides. A message met once must be surer than one that recurs. Documents holding a
judged message are found by a join on the hash, in which messages of very many documents are joined apart.

Defined results: null, empty and blank texts hold no message; a text of any length is cut whole; repeated messages and
documents are judged alike; a null source counts as a source of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import join_hot, spread, table, written
from talkmill.llm.language_seed import SEED
from talkmill.llm.residue_examples import ORDINARY, RESIDUE

RECUR_DOCS, RECUR_SOURCES = 3, 2  # a message recurs widely from so many documents or sources on
SLOT = "⟦slot⟧"
REMEMBER = 300_000

_TAGS = "a|abbr|b|body|br|button|code|div|em|footer|form|h[1-6]|head|header|hr|html|i|img|input|label|li|link|main|meta|nav|ol|option|p|pre|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|u|ul|video"
PLACEHOLDER = re.compile(
    rf"""\{{\{{\s*[#/^&>]?\s*[A-Za-z_][\w. |:-]*\}}\}}            # {{{{name}}}}
    |\{{%[^%\n]*%\}} | <%=?[^%\n]*%>                                # {{% if name %}}
    |\$\{{\s*[A-Za-z_][\w.]*\s*\}}                                  # ${{name}}
    |(?<![\w"'{{])\{{\s*[A-Za-z_][A-Za-z_.]*\s*\}}(?![\w}}])        # {{name}}
    |\[\[\s*[A-Za-z_][\w .-]*\]\]                                   # [[name]]
    |<<\s*[A-Za-z_][\w .-]*>>                                       # <<name>>
    |<(?!/?(?:{_TAGS})\s*/?>)[a-z]+(?:[ _-][a-z]+)*>                # <name>
    |@@[A-Za-z_]\w*@@                                               # @@name@@
    |(?<![\w\#])\#[A-Za-z]+(?:_[A-Za-z]+)*\#(?!\w)                  # #name#
    |(?<![\w%])%[A-Z]+(?:_[A-Z]+)*%(?!\w)                           # %NAME%
    |(?<!\w)__[A-Z]+(?:_[A-Z]+)*__(?!\w)                            # __NAME__
    |\[(?:INSERT|ENTER|ADD|YOUR|TYPE|CUSTOMER|AGENT|CLIENT|BUYER)\ [^\]\n]*\] | \[(?:[Ii]nsert|[Ee]nter|[Yy]our|[Aa]dd)\ [^\]\n]*\]
    |\[(?:customer|first|last|full|agent|client|buyer|project|unit|visit|booking|possession)[ _](?:name|no|number|day|date|id)\]
    """,
    re.X,
)
_DROP = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f­̀-ͯ•-‧​-‏‪-‮⁠-⁤ﬀ-ﬆ︀-️﻿！-￯₠-⃏①-⓿¼-¾←-⯿\U0001d400-\U0001d7ff\U0001f000-\U0001faff]+")
_CUT = re.compile(r"\s(?:(?<=[\n\r])[\n\r]*|(?<=[.?!।]\s)\s*)")  # runs of line breaks, and white space after the end of a sentence
_MARKS = re.compile(r"[{<\[$@#%_]")
#: What is masked: signs without which there is nothing to mask, the pattern, the mark.
_MASKS = (
    (re.compile(r"@|://|[wW]\."), re.compile(r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "⟦address⟧"),
    (re.compile(r"(?i)uary|march|april|may|june|july|august|ember|ober|day"), re.compile(r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\b"), "⟦date⟧"),
    (re.compile(r"\d"), re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b|\d[\d.,:/-]*"), "9"),
)


def clean(text: str) -> str:
    """Without signs that stand for nothing (controls, joiners, pictures, odd letter forms) and without Latin accents."""
    if text.isascii():
        return text
    out = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", _DROP.sub("", out)).replace("\xa0", " ")


def masked(message: str) -> str:
    """Lower case, with slots, numbers, addresses and dates masked and white space collapsed."""
    m = PLACEHOLDER.sub(SLOT, message) if _MARKS.search(message) else message
    for needed, pattern, mark in _MASKS:
        if needed.search(m):
            m = pattern.sub(mark, m)
    return " ".join(m.lower().split())


_SPEAKER = re.compile(r"^\s*(?:customer|agent|bot|buyer|staff|system|client|user)\s*:\s*", re.I)
_HELD: dict[str, tuple[str, ...]] = {}  # masked forms of parts a worker has met; only ever a matter of speed


def messages(text: str | None) -> list[str]:
    """The distinct masked messages of a text."""
    if not text:
        return []
    out: dict[str, None] = {}
    for part in _CUT.split(text):  # cleaning a part may show further ends of sentences in it, and hides none
        found = _HELD.get(part)
        if found is None:
            found = tuple(m for p in _CUT.split(clean(part)) if (m := masked(_SPEAKER.sub("", p))))
            if len(part) <= 400:
                if len(_HELD) >= REMEMBER:
                    _HELD.clear()
                _HELD[part] = found
        for m in found:
            out[m] = None
    return list(out)


def _messages(text: pa.Array) -> pa.Array:
    return pa.array([messages(t) for t in text.to_pylist()], pa.list_(pa.string()))


_messages.__annotations__ = {"text": pa.Array, "return": pa.Array}


# -- rules -----------------------------------------------------------------------------------------------------------
#: Notions and their words, without accents. Words of six letters or more are looked for in the letters alone, so that stray
#: blanks and signs do not hide them; shorter ones as whole words.
NOTIONS = {
    "script": "javascript, scripts, noscript, scripting, cookies, जावास्क्रिप्ट, జావాస్క్రిప్ట్",
    "on": "enable, activate, turn on, switch on, switched on, turned on, allow, turn it on, disabled, turned off, switched off, blocked, requires, required, must be, have to be, need to, needs, works only, only with, without, have been blocked, schalten sie, unterstutzt kein, necesita, aktivier, deaktivier, benotigt, einschalten, erlauben, habilit, activar, active, desactiv, requiere, ative, ativar, desativad, requer, precisa, चालू, सक्षम, सक्रिय, सुरू, ప్రారంభించ, ఆన్ చేయ",
    "browser": "browser, navegador, ब्राउज़र, ब्राउझर, బ్రౌజర్",
    "web": "page, site, website, browser, listing, link, url, resource, server, request, network, connection, service, portal, application, content, session, gateway, homepage, home page, upstream, database, seite, webseite, anzeige, dienst, sitzung, servidor, pagina, sitio, anuncio, enlace, sesion, sessao, servico, पृष्ठ, पेज, सर्वर, पान, संकेतस्थळ, పేజీ, సర్వర్",
    "fail": "not found, error, errors, unavailable, does not exist, no longer exists, no longer available, was removed, failed, failure, expired, denied, forbidden, unauthori, authoris, permission, refused, timeout, time-out, timed out, temporarily, is down, maintenance, overloaded, too many requests, went wrong, something broke, unexpected, could not, cannot be, will not load, not work, not supported, unsupported, does not support, unusual traffic, suspicious, limit exceeded, bad gateway, internal server error, nicht gefunden, fehler, serverfehler, abgelaufen, verweigert, nicht verfugbar, no encontrad, no existe, ya no esta, error interno, caducad, denegad, expirad, nao encontrad, nao existe, indisponivel, expirou, negado, erro, foi removid, नहीं मिला, त्रुटि, त्रुटी, उपलब्ध नहीं, मौजूद नहीं, सापडले नाही, उपलब्ध नाही, కనుగొనబడలేదు, లోపం",
    "act": "try again, try later, again later, reload, refresh, slow down, come back, go back, back to home, return to home, sign in, log in, login, upgrade, update it, update your browser, not a robot, are human, captcha, in a few minutes, after a while, versuchen sie, laden sie, spater noch einmal, intentelo, recargue, vuelva a, tente novamente, recarregue, पुनः प्रयास, मुख्य पृष्ठ, वापस जा, మళ్లీ ప్రయత్నించ",
    "aim": "to continue, to proceed, to go on, to see, to view, to run, to use, to display, be displayed, be shown, um die, fortzufahren, para ver, para continuar, देखने के लिए, जारी रखने, చూడటానికి",
    "status": "404 not found, page not found, bad gateway, gateway timeout, gateway time-out, service unavailable, internal server error, interner serverfehler, too many requests, access denied, permission denied, acceso denegado, acesso negado, zugriff verweigert, request id, rate limit",
    "trace": "traceback, nullpointer, exception, is not a function, of undefined, stack trace, out of memory, connection refused, panic:, fatal:, fatal error, could not connect",
    "filler": "lorem ipsum, dolor sit amet, consectetur adipiscing, dummy, placeholder, sample text, sample copy, sample paragraph, filler text, test entry, only a test, blindtext, blind text, platzhalter, mustertext, beispieltext, texto de ejemplo, texto de exemplo, texto de relleno, texto de prueba, texto provisor, texto de muestra, aqui va, aqui vem, aqui ira, aqui entra, hier steht, hier folgt, जल्द आ, नमूना, यहाँ, येथे, నమూనా, ఇక్కడ, goes here, text here, content here, summary here, description here, coming soon, text to follow, details to follow, to be filled, to be written, to be added, tbd, tba, todo, untitled",
    "swap": "replace, replaced, este texto, este parrafo, este paragrafo, dieser text, dieses absatz, before publishing, please ignore, ignore this, ersetzen, ersetzt, austauschen, sustituya, reemplace, substitua, definitiv, publicar, el texto, o texto, der text, description, descripcion, descricao, description of, paragraph, paragraf, parrafo, पाठ, विवरण, मजकूर, వచనం, వివరణ",
    "told": "had, said, says, told, wrote, writes, written that, reported, noted, joked, complain, mentioned, explained, asked, asks, admitted, showed, shows, saw, noticed, forwarded, screenshot, sounded, schrieb, sagte, dijo, escribio, disse, escreveu, कहा, लिखा, म्हणा, అన్నారు, చెప్పారు",
    "who": "he, she, they, her, his, caller, buyer, customer, client, agent, desk, owner, banker, lawyer, brother, sister, father, mother, wife, husband, family, colleague, marketing, kunde, cliente, ग्राहक, ग्राहकाने",
    "link": "so we, so i, because, whenever, instead of, and not, but, which, when, where, as if, in the earlier, in the price, should, wir haben, corregimos, corrigimos, pero, थी, था",
    "home": "flat, villa, unit, plot, parking, booking, loan, budget, price, rate, quotation, brochure, agreement, papers, keys, visit, tower, block, lift, terrace, tiles, kitchen, vertrag, wohnung, piso, contrato, apartamento, precio, proposta, फ्लैट, कीमत, घर, ఫ్లాట్, ధర",
}
_CODE = re.compile(r"(?:http )?(?:error|status|code|fehler|erro|http)(?: code| del? \w+)?[ :#-]*9(?: [a-z -]{0,24})?|9(?: [:-])? ?[a-z -]{0,24}|(?:reference|request|incident|ray)(?: (?:number|no|id|code))?[ :#.-]*(?:9|[0-9a-f.]{6,})")
_RAISED = re.compile(r"\b[a-z]+(?:error|exception)\b\s*:|\bfile \"[^\"]+\", line 9|\bin thread\b|\bfatal\b.*:|\bat [\w.]+\.\w+")
_IMPERATIVE = re.compile(r"^(?:please |kindly |bitte |por favor |कृपया |దయచేసి )?(?:enable|activate|turn|switch|allow|reload|refresh|update|upgrade|try|sign|log|go|return|confirm|prove|complete|slow|wait|replace|insert|add|type|write|ignore|habilite|active|ative|vuelva|tente|sustituya|substitua|aktivieren|laden|versuchen|click)\b|^(?:bitte|por favor|कृपया|దయచేసి)\b")
_SELF = re.compile(r"\b(?:this|your|you|our|we|ihre?|sie|diese[rs]?|dies|su|usted|esta?e?|sua|seu|voce|आप|यह|इसे)\b")
_SECOND = re.compile(r"\byou (?:asked|requested|wrote|said|saw)\b|\bwe noted\b")  # said to the reader, no report
_QUOTE_SLOT = re.compile(rf"[\"“”„«'‘][^\"“”»]*{SLOT}")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ॣఀ-౥‌‍'’])*")
_PLAIN = re.compile(r"[a-z ]+[.!]?")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_RUNS = tuple(r for row in _ROWS for r in (row, row[::-1]))


_NOT_LETTERS = re.compile(r"[^A-Za-z9]+")


def bare(message: str) -> str:
    """Letters, combining signs and masked numbers only."""
    if message.isascii():
        return _NOT_LETTERS.sub("", message)
    return "".join(ch for ch in message if ch.isalpha() or ch == "9" or unicodedata.category(ch)[0] == "M")


@lru_cache(maxsize=1)
def _notions() -> tuple[tuple[str, re.Pattern, re.Pattern | None], ...]:
    out = []
    for name, words in NOTIONS.items():
        long, short = [], []
        for w in map(str.strip, unicodedata.normalize("NFC", words).split(",")):
            letters = bare(w)
            (long if len(letters) >= 6 and w[-1] != ":" else short).append(letters if len(letters) >= 6 and w[-1] != ":" else w)
        by_word = rf"(?<!\w)(?:{'|'.join(map(re.escape, short))})(?![\w])" if short else None
        out.append((name, re.compile("|".join(map(re.escape, long)) or r"(?!)"), re.compile(by_word) if by_word else None))
    return tuple(out)


@lru_cache(maxsize=1)
def _triples() -> frozenset[str]:
    """Letter triples of ordinary words, ends included."""
    return frozenset(f"^{w}$"[k : k + 3] for w in _common() if w.isascii() for k in range(len(w)))


@lru_cache(maxsize=1)
def _common() -> frozenset[str]:
    """Words of ordinary sentences."""
    return frozenset(w for lines in (*SEED.values(), ORDINARY.splitlines()) for line in lines for w in _WORD.findall(clean(line).lower()))


def on_keys(word: str) -> bool:
    """Three letters or more that run along one row of a keyboard."""
    return len(word) >= 3 and any(word in r for r in _RUNS)


def pseudo(message: str, words: list[str]) -> bool:
    """A sentence of at least five words that are unlike ordinary ones: hardly any is known, nearly a third of the letter triples are not."""
    if len(words) < 5 or not _PLAIN.fullmatch(message):
        return False
    triples = [f"^{w}$"[k : k + 3] for w in words for k in range(len(w))]
    return sum(len(w) > 1 and w in _common() for w in words) <= 0.2 * len(words) and sum(t not in _triples() for t in triples) >= 0.31 * len(triples)


FEATURES = (*NOTIONS, "slot", "slot told", "slot quoted", "scripts on", "browser fails", "web fails", "web act", "act alone", "filler swap", "code", "raised", "imperative", "self", "fail self", "fail alone", "filler twice", "swap twice", "aims", "slot plain", "keys", "repeats", "pseudo", "narrates", "short", "worded", "long", "told web", "home fails")


def features(message: str) -> np.ndarray:
    """The rules that a masked message meets."""
    message = _SECOND.sub("you", message)
    letters = bare(message.replace(SLOT, ""))
    words = _WORD.findall(message.replace(SLOT, ""))
    found = {name: {*long.findall(letters), *(short.findall(message) if short else ())} for name, long, short in _notions()}
    hit = {name: bool(f) for name, f in found.items()}
    slot = SLOT in message
    told = hit["told"] or hit["link"]
    n = len(words)
    distinct = len(set(words))
    keys = sum(on_keys(w) for w in words)
    own = {
        "slot": slot, "slot told": slot and told, "slot quoted": slot and bool(_QUOTE_SLOT.search(message)), "slot plain": slot and not told and not _QUOTE_SLOT.search(message), "scripts on": hit["script"] and (hit["on"] or hit["fail"] or n <= 2), "browser fails": hit["browser"] and hit["fail"],
        "web fails": hit["web"] and hit["fail"], "web act": hit["web"] and hit["act"], "aims": hit["aim"] and (hit["script"] or hit["browser"] or hit["web"] and hit["act"]), "fail self": hit["fail"] and bool(_SELF.search(message)) and not hit["home"] and not hit["told"], "fail alone": hit["fail"] and not (hit["home"] or told or hit["who"]) and n <= 8, "filler twice": len(found["filler"]) >= 2, "swap twice": len(found["swap"]) >= 2, "act alone": hit["act"] and not hit["web"] and not hit["home"], "filler swap": hit["filler"] and (hit["swap"] or n <= 4),
        "code": bool(_CODE.fullmatch(message.rstrip(".!"))) and any(ch.isalpha() for ch in message) and (hit["fail"] or hit["web"] or hit["status"] or hit["act"] or not message[0] == "9"), "raised": bool(_RAISED.search(message)),
        "imperative": bool(_IMPERATIVE.search(message)), "self": bool(_SELF.search(message)), "keys": n >= 2 and keys >= 0.7 * n, "repeats": n >= 4 and distinct <= 2 or n >= 2 and all(len(set(w)) == 1 and len(w) > 1 for w in words),
        "narrates": (hit["told"] and hit["who"]) or (told and hit["who"]), "short": n <= 4, "worded": n > 2, "pseudo": pseudo(message, words), "long": n > 14, "told web": hit["told"] and (hit["web"] or hit["script"]), "home fails": hit["home"] and hit["fail"],
    }
    own |= hit
    own["home"] = hit["home"] and not slot and not own["raised"]
    return np.array([float(own[f]) for f in FEATURES])


#: Rules of which a message must meet one to be a candidate at all.
TELLING = ("slot", "scripts on", "browser fails", "web fails", "web act", "act", "fail self", "fail alone", "filler twice", "swap twice", "status", "trace", "filler", "code", "raised", "keys", "repeats", "pseudo")
_TELLING = [FEATURES.index(x) for x in TELLING]
#: A message met once must also meet one of these: a short stock phrase alone tells nothing.
SURE = tuple(x for x in TELLING if x not in ("filler", "act")) + ("long", "filler twice", "worded")
_SURE = [FEATURES.index(x) for x in SURE]
L2, STEPS, ONCE = 3e-4, 100, 0.4  # ridge, Newton steps at most, and how much surer a message met once must be (in logits)


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Of the rules, and the constant last. Both classes weigh alike."""
    x = [features(masked(clean(m))) for kind in RESIDUE.values() for m in kind.splitlines()]
    n = len(x)
    x += [features(masked(clean(m))) for m in ORDINARY.splitlines()]
    a = np.column_stack([np.array(x), np.ones(len(x))])
    y = np.concatenate([np.ones(n), np.zeros(len(x) - n)])
    c = np.where(y == 1, 0.5 / n, 0.5 / (len(x) - n)) * len(x)
    w = np.zeros(a.shape[1])
    ridge = L2 * len(x) * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (c * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: The notions without which no telling rule is met but by slot, code, raised, keys, repeats or pseudo.
NEEDED = ("script", "fail", "act", "swap", "status", "trace", "filler")


@lru_cache(maxsize=1)
def _needed() -> tuple[re.Pattern, re.Pattern]:
    of = [x for x in _notions() if x[0] in NEEDED]
    return re.compile("|".join(x[1].pattern for x in of)), re.compile("|".join(x[2].pattern for x in of if x[2]))


def may_tell(message: str) -> bool:
    """False only for messages that meet no telling rule; quick, as most are such."""
    long, short = _needed()
    if SLOT in message or long.search(bare(message)) or short.search(message) or _RAISED.search(message) or _CODE.fullmatch(message.rstrip(".!")):
        return True
    words = _WORD.findall(message)
    return any(map(on_keys, words)) or len(set(words)) <= 2 or pseudo(message, words) or all(len(set(w)) == 1 for w in words)


def scored(message: str) -> tuple[float | None, np.ndarray | None]:
    if not may_tell(message):
        return None, None
    x = features(message)
    return (float(x @ weights()[:-1] + weights()[-1]) if x[_TELLING].any() else None), x


def score(message: str) -> float | None:
    """Logit that a masked message is residue; None if it meets no telling rule."""
    return scored(message)[0]


def kind_of(message: str, docs: int, sources: int) -> str | None:
    """What a masked message is, given in how many documents and sources it stands; None for content."""
    s, x = scored(message)
    wide = docs >= RECUR_DOCS or sources >= RECUR_SOURCES
    if s is None or s < (0 if wide else ONCE) or not wide and not x[_SURE].any():
        return None
    return "placeholder" if SLOT in message else "phrase"


def judged(message: Column, docs: Column, sources: Column) -> Column:
    """Kind of residue of a masked message, or null."""

    def judge(message: pa.Array, docs: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([kind_of(*x) for x in zip(message.to_pylist(), docs.to_pylist(), sources.to_pylist())], pa.string())

    judge.__annotations__ = {"message": pa.Array, "docs": pa.Array, "sources": pa.Array, "return": pa.Array}
    # else a filter on the result would have it judged twice
    return F.arrow_udf(judge, "string").asNondeterministic()(message, docs, sources)


def residue(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, kind) of each residue kind of each document."""
    found = F.arrow_udf(_messages, "array<string>")(F.col(text))
    # written once: the counts and the join both read it, and cutting texts is the dear part
    parts = written(spread(documents.select(F.col(key).alias("key"), F.col(text).alias(text), F.col(source).alias("source"))).select("key", "source", F.explode(found).alias("message")).withColumn("h", F.unhex(F.md5("message"))))
    per = parts.groupBy("h", "source").agg(F.count("*").alias("n"), F.max("message").alias("message"))
    seen = per.groupBy("h").agg(F.sum("n").alias("docs"), F.count("*").alias("sources"), F.max("message").alias("message"))
    bad = written(seen.withColumn("kind", judged(F.col("message"), F.col("docs"), F.col("sources"))).filter("kind is not null").select("h", "kind", "docs"))
    return join_hot(parts.select("key", "h"), bad, "h", "docs").select(F.col("key").alias(key), "kind").distinct()


def without_residue(documents: DataFrame, **columns: str) -> DataFrame:
    """The documents with no residue in them."""
    key = columns.get("key", "doc_id")
    return documents.join(residue(documents, **columns).select(key).distinct(), key, "left_anti")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_clean(spark, sf_dir: str) -> DataFrame:
    return without_residue(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")
