"""Defective prompt and response pairs, each with the type of its defect.

A suffix automaton of the prompt is walked along the response to find how much of it is copied; an automaton of refusal
phrases, and of words for who speaks, negation, ability and answering that make refusals together, labels its sentences;
delimiter stacks and its last words tell whether it stops early; function words and scripts vote for its language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Share of a response's letters and digits that must come from its prompt for a copy.
COPIED = 0.6
#: Shortest copied run that counts, in letters and digits; half of that in prompts of few characters.
RUN = 8

# Phrases by which a sentence declines to answer.
REFUSALS = (
    "i can't help", "i cannot help", "i can't answer", "i cannot answer", "i can't assist", "i cannot assist", "i can't provide", "i cannot provide", "i can't discuss", "i cannot discuss",
    "not able to answer", "not able to help", "not able to assist", "not able to provide", "unable to answer", "unable to help", "unable to assist", "unable to provide",
    "i won't provide", "i will not provide", "i won't answer", "i must decline", "have to decline", "i decline", "must refuse", "have to refuse", "do not allow me", "don't allow me", "not allowed to",
    "not something i can", "have to pass", "inappropriate for me", "not enough context", "not enough information", "no answer is possible", "no comment on", "as an ai", "say nothing about", "does not mention", "i do not know", "i don't know",
    "无法回答", "不能回答", "不便回答", "无法作答", "不能提供", "无法提供", "无法帮助", "不能帮助", "拒绝回答", "超出了我的能力", "没有关于", "我不知道",
    "ablehnen", "keine angaben vor", "nicht beantworten", "nicht helfen", "keine auskunft", "nicht weiterhelfen", "weiß ich nicht", "enthält keine", "nicht möglich zu antworten",
    "refuser cette demande", "ne peux pas répondre", "ne peux donc pas répondre", "ne peux pas vous aider", "ne peux pas aider", "ne suis pas en mesure", "ne dit rien de", "je ne sais pas", "impossible de répondre",
    "no puedo ayudar", "no puedo responder", "no puedo contestar", "rechazar esta", "no es posible responder", "no me es posible", "no estoy autorizad", "no menciona", "no lo sé", "no puedo proporcionar",
)
# Words of refusals by what they say. A sentence declines if one says that it refuses or has no answer, or if the
# speaker, a negation, an ability and an act of answering come together.
REFUSAL_WORDS = {
    "self": "i we me my us i'm i'd i'll we're assistant ich wir mir mich je nous me m 我 我们 本助手",
    "negation": "not no cannot can't won't don't couldn't wouldn't unable isn't aren't never nothing nicht nichts nie kein keine keinen keinerlei ne n pas non impossible 无法 不能 不便 不会 不想 不方便 不可以 未能",
    "ability": "can cannot can't could couldn't able unable won't will would allowed permitted possible willing comfortable position going want don't erlaubt befugt kann können darf dürfen möchte will werde könnte möglich imstande lage peux pouvons puis mesure autorisé autorisée habilité souhaite veux possible impossible 无法 不能 不便 不会 不想 不方便 不可以 未能",
    "answer": "answer answering help assist provide discuss tell respond comment comply explain share advise fulfill support disclose reveal elaborate beantworten antworten helfen weiterhelfen sagen äußern mitteilen bereitstellen erklären eingehen unterstützen répondre aider dire fournir donner expliquer parler commenter renseigner communiquer 回答 回复 答复 提供 帮助 帮忙 协助 解答 作答 讨论 透露 评论",
    "spanish": "puedo podemos podré quiero queremos deseo debo debemos capaz posible",
    "spanish_answer": "responder responderle responderte contestar contestarle ayudar ayudarle ayudarte decir decirle proporcionar proporcionarle dar darle explicar hablar compartir comentar",
    "refuse": "refuse refusing decline declining lehne verweigere verzichte ablehne refusons décline déclinons rechazo rechazamos niego declino 拒绝 谢绝 恕不",
}
# Phrases by which a sentence says that there is no answer.
NO_ANSWER = (
    "outside my scope", "outside of my scope", "out of my scope", "beyond my scope", "beyond my capabilities", "beyond my ability", "beyond what i can", "outside what i can", "against my guidelines", "against my policy", "rather not", "prefer not to", "insufficient information", "no information about", "no information on", "have no idea", "have no answer",
    "außerhalb meines", "außerhalb meiner", "übersteigt meine", "lieber nicht", "keine informationen", "hors de mon", "hors de mes", "dépasse mes", "préfère ne pas", "aucune information", "fuera de mi", "fuera de mis", "supera mis", "prefiero no", "ninguna información", "超出我的", "不在我的", "不知道", "不清楚", "没有相关信息", "没有足够的信息",
)
# Single words that decline beside a courtesy.
BARE_NO = {"no", "nope", "nein", "non", "不", "不行", "but", "aber", "mais", "pero"}
# Phrases of sentences that say nothing beside a refusal.
COURTESIES = (
    "contact your administrator", "ask a qualified", "please consult", "sorry", "apologi", "请联系", "抱歉", "对不起", "遗憾", "wenden sie sich", "tut mir leid", "bedaure", "entschuldig",
    "contactez", "veuillez contacter", "désolé", "regrette", "póngase en contacto", "contacte con", "lo siento", "lamento", "disculp",
)
COURTESY_WORDS = tuple({w for p in COURTESIES for w in p.split() if len(w) > 1})
# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is was be are were that this which with for on by had has have it not as at from until after before when while because so both only its into once again what how why does do",
    "de": "der die das und oder von zu ist war sind dass mit für auf durch hatte haben es nicht als bei nach vor wenn während weil den dem ein eine einen einer im in um sich wurde wird erst muss sie bis beim wieder aus noch sobald was wie warum",
    "fr": "le la les et ou de du des un une est était sont que qui avec pour sur par il elle ne pas plus dans en après avant quand pendant car ce cette au aux a été à l d reste n sous comme puis nous mais dès lorsque",
    "es": "el la los las y o de del un una es era son que con para por se no más en al tras antes cuando mientras porque su fue ya está hasta sin lo como este esta desde pero si cada había podemos pudimos",
}
# Function words of other languages in Latin script, those apart that one of the above has too.
OTHER_WORDS = "il gli che di della dello dei delle nel nella sono è stato anche questo questa più come però perché não uma com os em é ao dos das são foi mais também isso muito já pelo pela het een van niet omdat meer wel zijn naar dan als er wordt deze dat voor naar maar ook och att det är inte på för med som har var nie jest się na że które przez oraz ale ve bir bu için ile olarak değil"
# Letters of other scripts.
OTHER_SCRIPTS = r"[\u0370-\u052f\u0590-\u06ff\u0900-\u0e7f\u3040-\u30ff\u1100-\u11ff\uac00-\ud7af]"
# How prompts ask for the language of the answer.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés 英文 英语",
    "zh": "chinese chinesisch chinois chino 中文 汉语",
    "de": "german deutsch allemand alemán 德文 德语",
    "fr": "french französisch français francés 法文 法语",
    "es": "spanish spanisch espagnol español 西班牙文 西班牙语",
}
# Texts that stand for no answer, without their punctuation.
PLACEHOLDERS = {"", "null", "none", "nil", "nan", "na", "n a", "tbd", "todo", "br", "nbsp", "undefined", "empty", "answer", "response", "antwort", "réponse", "respuesta", "回答", "答", "答案", "no answer", "placeholder", "lorem ipsum", "keine antwort", "sans réponse", "sin respuesta", "无", "暂无", "待补充", "待定", "同上", "见上文", "tbc", "tba", "to follow", "coming soon", "see above", "as above", "siehe oben", "folgt", "voir ci dessus", "à compléter", "véase arriba", "por completar", "pendiente", "pending", "placeholder text"}
# Last words after which a sentence cannot end.
HANGING = set("and or but because then the a an of to with for which that und oder aber weil dass der die das den mit für et ou mais parce que car le la les de du des avec pour y o pero porque el los las del con para 而且 并且 以及 因为 但是 然后 或者 和 或 与 的".split())

# Placeholders by their shape: something to be done, something not there, a few words in brackets that hold a place.
PLACEHOLDER = re.compile(r"(?:still )?to be (?:done|determined|added|completed|filled in|provided|written|confirmed|announced|supplied)|(?:answer |response |text )?not (?:yet )?(?:available|provided|applicable|written)|no (?:answer|response|reply|data|content|text)(?: (?:yet|available|given|provided))?")
BRACKETED = re.compile(r"\W*(?:\[{1,2}|<{1,2}|\{{2}|\(|【|（)\s*[^\W\d_]+(?:[ _-][^\W\d_]+){0,3}\s*(?:\]{1,2}|>{1,2}|\}{2}|\)|】|）)\W*")
CJK = re.compile(r"[㐀-鿿豈-﫿]")
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
NAMES = re.compile(r"[!-~]*[0-9_/\\=@#<>{}$|][!-~]*")
SCRIPTS, KANA = re.compile(OTHER_SCRIPTS), re.compile(r"[\u3040-\u30ff]")
ALNUM, TAGS, SPLIT = re.compile(r"[^\W_]+"), re.compile(r"</?[a-zA-Z][^>]*>|&nbsp;|```\w*"), re.compile(r"[^\w']+|(?<=\w)'(?=\w{3})")
NAMED = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
ASKED_LANGUAGE = re.compile(rf"\b(?:in|auf|en|reply|answer|respond|antworte\w*|répond\w*|respond\w*)\s+({'|'.join(NAMED)})\b|用({'|'.join(NAMED)})", re.I)
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
LIST_ITEM = re.compile(r"^\s*(?:[-*+•·–~]|\d{1,3}[.)、]|[(（]?[a-zA-Z\d][)）])(?:\s+|$)")
CLOSED = tuple(".!?。！？…:\"'”’»)）]】}`|*_>；;")


class SuffixAutomaton:
    """All substrings of a text, as an automaton of the least number of states."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, text: str, least: int) -> list[bool]:
        """Which characters of text lie in a run of at least so many that the automaton's text holds too."""
        out, state, size = [False] * len(text), 0, 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                state = size = 0
            if size >= least:
                for j in range(i, i - size, -1):
                    if out[j]:
                        break
                    out[j] = True
        return out


SIGNS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    return SIGNS.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


@lru_cache(maxsize=4096)
def prompt_letters(prompt: str) -> tuple[str, frozenset[str], int]:
    """A prompt's letters and digits, its runs of the least length that counts, and that length."""
    own = letters(prompt)
    size = min(RUN, max(3, len(own) // 2))
    return own, frozenset(own[i : i + size] for i in range(len(own) - size + 1)), size


@lru_cache(maxsize=512)
def prompt_automaton(prompt: str) -> SuffixAutomaton:
    return SuffixAutomaton(prompt)


@lru_cache(maxsize=1)
def phrase_automaton() -> ahocorasick.Automaton:
    """Phrases and words of refusals with what they say; Latin words only as whole words."""
    kinds: dict[str, set[str]] = {}
    for kind, phrases in (("courtesy", COURTESIES), ("refusal", REFUSALS), ("refusal", NO_ANSWER)):
        for p in phrases:
            kinds.setdefault(p, set()).add(kind)
    for kind, words in REFUSAL_WORDS.items():
        for w in words.split():
            kinds.setdefault(w if CJK.match(w) else f" {w} ", set()).add(kind)
    found = ahocorasick.Automaton()
    for p, k in kinds.items():
        found.add_word(p, frozenset(k))
    found.make_automaton()
    return found


def declines(sentence: str) -> tuple[bool, bool]:
    """Whether a sentence in lower case declines, and whether it is a courtesy."""
    plain = f" {SPLIT.sub('  ', sentence)} "
    kinds: set[str] = set()
    for text in (sentence, plain):
        for _, k in phrase_automaton().iter(text):
            kinds |= k
    courtesy, words = "courtesy" in kinds, WORDS.findall(sentence)
    if "refusal" in kinds:
        return True, courtesy
    chinese = bool(CJK.search(sentence))
    if "refuse" in kinds and ("self" in kinds or chinese or len(words) <= 4):
        return True, courtesy
    if {"negation", "ability", "answer"} <= kinds and ("self" in kinds or chinese and len(sentence) < 40):
        return True, courtesy
    if {"negation", "spanish", "spanish_answer"} <= kinds:
        return True, courtesy
    if {"self", "negation", "answer"} <= kinds and len(words) <= 8:
        return True, courtesy
    if not courtesy or BARE_NO.isdisjoint(words):
        return False, courtesy
    return all(w in BARE_NO or w.startswith(COURTESY_WORDS) for w in words), courtesy


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    if len(response) > 400 and ALNUM.search(response):
        return False
    bare = TAGS.sub(" ", response)
    words = " ".join(ALNUM.findall(bare)).lower()
    return words in PLACEHOLDERS or len(bare) < 80 and (PLACEHOLDER.fullmatch(words) is not None or BRACKETED.fullmatch(bare) is not None)


def is_copy(prompt: str | None, response: str) -> bool:
    """Whether the response gives the prompt back and nothing after it. A lead-in before it is only its dress."""
    own, runs, size = prompt_letters(prompt or "")
    text = letters(response)
    if len(own) < 4 or not text or len(text) < 0.4 * len(own) or not any(text[i : i + size] in runs for i in range(len(text) - size + 1)):
        return False
    cover = prompt_automaton(own).covered(text, size)
    n = sum(cover)
    if n < COPIED * len(text) or n < 0.5 * len(own):
        return False
    tail = len(text) - max(i for i, c in enumerate(cover) if c) - 1
    lead = next(i for i, c in enumerate(cover) if c)
    inner = len(text) - n - tail - lead
    return tail <= 1 and inner <= max(3, 0.2 * n) and lead <= 30


def is_refusal(response: str) -> bool:
    """Whether every sentence declines or is a courtesy, and one declines."""
    text, declined = unicodedata.normalize("NFKC", response).replace("’", "'").lower(), False
    for sentence in SENTENCE.split(text):
        if not letters(sentence):
            continue
        no, courtesy = declines(sentence)
        if not (no or courtesy) or len(sentence) > 220:
            return False
        declined |= no
    return declined


def language_votes(text: str) -> Counter:
    """Votes of function words and Chinese characters; words of several languages count little, code, names and commands not at all."""
    plain = NAMES.sub(" ", CODE.sub(" ", text)).replace("’", " ").replace("'", " ")
    votes = Counter({"zh": len(CJK.findall(plain)) / 2, "other": 2 * len(SCRIPTS.findall(plain)) / 3})
    if votes["other"]:  # Japanese is written with Chinese characters too
        votes["other"] += votes["zh"] if KANA.search(plain) else 0
        votes["zh"] = 0 if KANA.search(plain) else votes["zh"]
    known = voters()
    for word in WORDS.findall(plain.lower()):
        langs = known.get(word)
        if langs:
            for lang in langs:
                votes[lang] += 1 if len(langs) == 1 else 0.25
    return votes


@lru_cache(maxsize=1)
def voters() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out.setdefault(w, []).append(lang)
    for w in OTHER_WORDS.split():
        if w not in out:
            out[w] = ["other"]
    return out


def winner(votes: Counter, least: float) -> str | None:
    top = votes.most_common(2)
    if not top or top[0][1] < least or len(top) > 1 and top[1][1] > 0.6 * top[0][1]:
        return None
    return top[0][0]


@lru_cache(maxsize=4096)
def wanted_language(prompt: str) -> str | None:
    """The language a prompt asks for, else the one it is in."""
    asked = ASKED_LANGUAGE.search(prompt)
    if asked:
        return NAMED[(asked[1] or asked[2]).lower()]
    votes = language_votes(prompt)
    if re.search("[¿¡]", prompt):
        votes["es"] += 2
    best = winner(votes, 1)
    return None if best == "other" else best


# One-word answers by language.
SHORT_ANSWERS = {"yes": "en", "ja": "de", "nein": "de", "oui": "fr", "non": "fr", "sí": "es", "是": "zh", "否": "zh", "可以": "zh", "不可以": "zh"}


def is_other_language(prompt: str | None, response: str) -> bool:
    want = wanted_language(prompt or "")
    if want is None:
        return False
    short = SHORT_ANSWERS.get(" ".join(WORDS.findall(response.lower())))
    if short:
        return short != want
    votes = language_votes(response)
    most = max((n for lang, n in votes.items() if lang != want), default=0)
    return most >= 2 and votes[want] <= 0.4 * most


def is_truncated(response: str) -> bool:
    """Whether code, brackets, a table row, a list or a sentence stays open at the end."""
    text = response.rstrip()
    fences = len(re.findall(r"^\s*```", text, re.M))
    if fences % 2:
        return True
    if fences and text.endswith("```"):
        return False
    plain = CODE.sub(" ", text)
    if plain.count("`") % 2:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if last.startswith("|"):
        width = next((x.count("|") for x in lines if re.match(r"^\s*\|?[\s:|-]+\|[\s:|-]*$", x) and "-" in x), last.count("|"))
        return not last.endswith("|") or last.count("|") < width
    stack: list[str] = []
    for c in plain:
        if c in "([{（【「":
            stack.append(c)
        elif c in ")]}）】」" and stack and stack[-1] == "([{（【「"[")]}）】」".index(c)]:
            stack.pop()
    if stack and not (len(lines) > 1 and LIST_ITEM.match(last) and stack[-1] not in last):
        return True
    if LIST_ITEM.match(lines[-1]):
        rest = LIST_ITEM.sub("", lines[-1]).strip()
        return not rest or rest[-1] in ",，、:：(" or (rest.split()[-1].lower() in HANGING)
    if re.fullmatch(r"[-*+•]|\d{1,3}[.)]?", last) and len(lines) > 1:
        return True
    if last[-1] in ",，、:：;；(=-–—" and len(letters(text)) > 3:
        return True
    words = last.rstrip("*_\"'”’»`").split()
    prose = len(words) >= 5 or len(CJK.findall(last)) >= 8
    if not prose:
        return bool(words) and len(words) > 1 and words[-1].lower() in HANGING
    if words[-1].lower() in HANGING or any(last.endswith(h) for h in HANGING if CJK.match(h) and len(h) > 1):
        return True
    return not last.endswith(CLOSED)


def defect(prompt: str | None, response: str | None) -> str | None:
    """The type of a pair's defect, or None. A null or blank prompt only hides copies and foreign languages."""
    if is_empty(response):
        return "empty"
    if is_copy(prompt, response):
        return "copy"
    if is_refusal(response):
        return "refusal"
    if is_other_language(prompt, response):
        return "other_language"
    return "truncated" if is_truncated(response) else None


def defective_pairs(items: DataFrame, key: str = "item_id", prompt: str = "query", response: str = "response") -> DataFrame:
    """key, defect of each defective pair. Repeated rows count once; rows with a null key keep it.

    What built-in expressions can tell is not sent to Python: responses without a letter or digit are empty, those that equal
    their prompt are copies. The rest comes sorted by prompt, so that a prompt's automaton and language are made once.
    """
    kind = dict(items.dtypes)[key]
    p, r = F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(response), F.lit(""))
    sure = F.when(~r.rlike(r"[\p{L}\p{N}]"), "empty").when((r == p) & (F.length(p) >= 20) & (F.size(F.split(p, r"[^\p{L}\p{N}]+")) > 5), "copy")
    rows = items.select(F.col(key), p.alias("_p"), r.alias("_r"), sure.alias("defect"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({key: batch[key], "defect": [defect(p, r) for p, r in zip(batch["_p"], batch["_r"])]})
            yield out[out["defect"].notna()]

    told = rows.where("defect is not null").select(key, "defect")
    judged = spread(rows.where("defect is null").select(key, "_p", "_r")).sortWithinPartitions("_p").mapInPandas(run, f"{key} {kind}, defect string")
    return told.unionByName(judged).distinct()
