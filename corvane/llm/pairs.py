"""Defects of prompt and response pairs.

Copies: the tokens of prompt and response are aligned by shingle containment and longest common subsequence. Refusals:
sentences are aligned with templates (``refusals``). Languages: scripts and character n-gram profiles (``languages``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.context import materialize
from corvane.functions.text import clean_role, strip_white
from corvane.llm import languages, refusals
from corvane.llm.conversations import slot_of
from corvane.operators.deliveries import latest_deliveries

# Templates, placeholders and function words.
#: What stands for no answer, without outer marks.
PLACEHOLDERS = frozenset("none|null|nil|nan|na|n/a|undefined|todo|tbd|tba|fixme|empty|blank|void|placeholder|pending|no answer|no response|no response generated|no answer generated|no output|no content|no text|no reply|no result|no results|no data|not available|not applicable|empty response|empty answer|response unavailable|answer unavailable|generation failed|an error occurred|something went wrong|internal error|internal server error|request timed out|timed out|timeout|please try again|please try again later|answer goes here|keine antwort|keine antwort verfügbar|pas de réponse|aucune réponse|sin respuesta|sin contenido|回答なし|なし|該当なし|未回答|無回答".split("|"))
#: Words that dress up a copied question.
_DRESS = frozenset("q a question answer frage antwort réponse respuesta pregunta your votre ihre su you asked ask sure here is the to of p br b i em strong div span html body blockquote user assistant prompt 質問 回答 質 問 回 答 ご は".split())
#: Words by which a lead-in speaks of the question itself.
_OF_ASKING = frozenset("question ask asked asking asks message prompt request query wrote written repeat repeated answer reply frage gefragt fragten fragen antwort anfrage nachricht demande demandé question réponse message pregunta preguntó preguntaste pregunta respuesta mensaje consulta 質 問 答".split())
#: Function words; a short answer with one that no phrase has is a sentence.
FUNCTION_WORDS = {
    "en": "the and is are was were be been of which what who how why when does do did with from by this that it its an has have had will would can could should must may not but than then before after while unless until because whenever every each there their they at as".split(),
    "de": "der die das und ist sind war wird werden wurde wie was wer warum wann welcher welche welches nicht mit von bei für auf ein eine einer eines einem einen im zum zur dem den des sie wenn dass sobald nach aus oder auch kann muss darf alle dieser dafür".split(),
    "fr": "le les des du et est sont était qui que quel quelle quels quelles pourquoi comment quand ne pas avec dans par sur un une pour ce cette il elle lorsque dès aux au mais ou où pendant avant après chaque doit peut je qu".split(),
    "es": "el los las del y es son era qué cuál cuándo cómo quién por para con en un una al cuando desde hasta que se lo su sus sin más hay está están antes después cada debe puede esta este eso".split(),
}
#: Words with which no sentence or list item ends.
_OPEN_WORDS = frozenset("the a an and or of to in on at by with from for than that which is are was were be its their if when while because unless until as but into through between after before der die das und oder mit von bei für auf ein eine einer im zum zur dem den des wenn dass weil le la les des du de et ou un une que qui dans par pour el los las del y o un una que en con por para se al su".split())
#: Function words of phrases; any other one makes a sentence of a short answer.
_PHRASE_WORDS = frozenset("the and of with from by its an before after until every each their at as der die das und mit von bei für auf ein eine einer eines einem einen im zum zur dem den des nach aus oder alle dieser le les des du et avec dans par sur un une pour ce cette au aux ou pendant avant après chaque el los las del y por para con en un una al desde hasta lo su sus sin más antes después cada este esta".split())
_ALL_FUNCTION_WORDS = frozenset(w for own in FUNCTION_WORDS.values() for w in own)
_SENTENCE_WORDS = _ALL_FUNCTION_WORDS - _PHRASE_WORDS
#: Whole answers of one word.
_YES_OR_NO = frozenset("yes no ja nein oui non sí ok okay".split())

_CITATION = re.compile(r"\s*\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_CITATIONS_AT_END = re.compile(r"(?:\s*\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\])+\s*$")
_SEEN = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LEAD_END = re.compile(r"[:\"“«「>‘„]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»)]*\s+|(?<=[。！？])|\n+")
_QUOTED = re.compile(r"\"[^\"\n]{2,}\"|“[^”\n]{2,}”|«[^»\n]{2,}»|「[^」\n]{2,}」")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
_ITEM = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s+")
_BARE_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d{1,3}[.)])\s*$")
_LAST_WORD = re.compile(r"([^\W\d_]+)$")
_AFTER_STOP = re.compile(r"[.!?][\"”»)]*\s+\S|[。！？].")
#: A part of a name: with a capital, a digit or a joint.
_NAME = re.compile(r"(?=[^\W_]{2})[A-ZÄÖÜÉÀÈÂÊÎÔÛÇÑÁÍÓÚ]|\S*(?:\d|\w[-_./]\w)")


def tokens_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; kana and ideographs one by one."""
    return _TOKEN.findall(text.casefold())


def is_empty(answer: str | None) -> bool:
    """Whether nothing is visible, or only marks, citation numbers, a placeholder or a fallback notice."""
    if answer is None:
        return True
    bare = _CITATION.sub("", answer)
    if not _SEEN.search(bare):
        return True
    name = re.sub(r"^[\W_]+|[\W_]+$", "", bare.casefold())
    return name in PLACEHOLDERS


def is_refusal(answer: str, least: float = refusals.LEAST) -> bool:
    """Whether the answer declines: a sentence, quotations taken out, fills a refusal template, and what else it says is
    not more than that. Apologies, pointers elsewhere, questions and a list that a colon announces say nothing."""
    text = _QUOTED.sub('""', _CITATION.sub("", answer))
    declined = other = 0
    listing = False
    for sentence in map(str.strip, _SENTENCE.split(text)):
        if not sentence:
            continue
        size = len(tokens_of(sentence))
        if refusals.refusal_score(sentence) >= least:
            declined += size
        elif (listing and _ITEM.match(sentence)) or sentence[-1] in "?？" or refusals.goes_along(sentence):
            continue
        elif sentence[-1] in ":：":
            listing = True
        else:
            other += size
    return declined > 0 and other <= declined


def _common(question: list[str], answer: list[str]) -> tuple[int, int]:
    """Lengths of the longest common subsequences of ``question`` with ``answer`` and with ``answer`` less its last
    token, by Hyyrö's bit-parallel recurrence: a row of the table is one number, so each token of the answer is a step."""
    masks: dict[str, int] = {}
    for n, t in enumerate(question):
        masks[t] = masks.get(t, 0) | 1 << n
    full = (1 << len(question)) - 1
    row = before = full
    for t in answer:
        before = row
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(question) - row.bit_count(), len(question) - before.bit_count()


def _nothing_but(question: list[str], answer: list[str]) -> int:
    """The number of tokens of ``answer`` that align with copies of ``question``, if it consists of nothing but these
    and few changed tokens inside them, else 0."""
    n, m = len(question), len(answer)
    few = max(1, n // 5)
    for whole, least in ((question, 0.6 * n), (question * (m // n + 1), 0.8 * n)):
        found, shorter = _common(whole, answer)
        copies = max(1, round(found / n))
        if found >= least * copies and m - found <= copies * few and shorter < found:
            # the first token is part of a copy as well
            first, less = _common(whole[::-1], answer[::-1])
            if less < first:
                return found
    return 0


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer has nothing but the question, once or more often.

    The share of the answer's shingles (two tokens) that the question contains sorts out most pairs; for the others a
    longest common subsequence tells how many tokens of the answer belong to copies of the question. Besides these it
    may hold dress: labels, a lead-in up to a colon or quotation mark (few words, or one that speaks of the question itself), and one
    changed token in five.
    """
    if not question:
        return False
    bare = _CITATION.sub("", answer).casefold()
    q, a = tokens_of(question), tokens_of(bare)
    if not q or not a:
        return False
    own = set(q)
    if len(q) == 1:
        return q[0] in a and all(t in own or t in _DRESS for t in a)
    pairs = set(zip(q, q[1:]))
    if sum(x in pairs for x in zip(a, a[1:])) < 0.15 * (len(a) - 1):
        return False
    if "".join(q) == "".join(a):
        return True
    undressed = lambda tokens: [t for t in tokens if t in own or t not in _DRESS]
    if _nothing_but(q, undressed(a)):
        return True
    for mark in _LEAD_END.finditer(bare):
        said = tokens_of(bare[: mark.end()])
        lead = sum(t not in _ALL_FUNCTION_WORDS for t in undressed(said))
        if lead > len(a) / 2:
            break
        room = 2 if not _OF_ASKING.isdisjoint(said) else 0.2
        copied = _nothing_but(q, undressed(tokens_of(bare[mark.end() :])))
        if copied and lead <= max(1, room * copied):
            return True
    return False


def differs(question: str | None, answer: str) -> bool:
    """Whether the answer, code and quotations taken out, is in another language than the question."""
    bare = lambda text: _QUOTED.sub(" ", _CODE.sub(" ", text or ""))
    return languages.differs(bare(question), bare(answer))


def _short_ending(bare: str) -> tuple[str, str | None]:
    """How a line of a few words without a full stop ends. Only a bare name, a number or a yes or no is whole by itself;
    a sentence, or what follows one, is broken, and with any other phrase the use of its last word tells."""
    words = tokens_of(bare)
    if _AFTER_STOP.search(bare) or bare.count('"') % 2 or not _SENTENCE_WORDS.isdisjoint(words):
        return "broken", None
    word = _LAST_WORD.search(bare)
    if not word or bare.casefold() in _YES_OR_NO or (_PHRASE_WORDS.isdisjoint(words) and all(_NAME.match(part) for part in bare.split())):
        return "whole", None
    own = word[1].casefold()
    return ("broken", None) if own in _OPEN_WORDS else ("open", own)


def ending_of(answer: str) -> tuple[str, str | None]:
    """How an answer ends: 'whole', 'broken', or 'open' with its last word where only the use of that word can tell."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return "broken", None
    bare = _CITATIONS_AT_END.sub("", text).rstrip()
    if bare.endswith("```"):
        return "whole", None
    if text.rfind("[") > text.rfind("]") and len(text) - text.rfind("[") < 12:
        return "broken", None
    if _BARE_ITEM.search(text) and "\n" in text:
        return "broken", None
    end = bare[-1:]
    if end in ",;:、，；–—-‐(（[{/=+&":
        return "broken", None
    if bare.count("`") % 2 and not bare.count("```"):
        return "broken", None
    line = bare.rsplit("\n", 1)[-1]
    item = _ITEM.match(line)
    if not end.isalnum():
        return "whole", None
    body = line[item.end() :] if item else line
    if not item:
        head = bare[: -len(line)].rstrip()
        if _CJK.match(end) or len(tokens_of(bare)) > 8 or head:
            return "broken", None
        return _short_ending(bare)
    # a list item needs no full stop, but prose that follows in its line does
    if re.search(r"(?:[.!?]|\])\s+\S", body) or re.search(r"[。！？].", body):
        return "broken", None
    if _CJK.match(end):
        return ("whole" if end in "すたるいんだうくつぬむぐ" or not _KANA.match(end) else "broken"), None
    word = _LAST_WORD.search(body)
    if not word:
        return "whole", None
    own = word[1].casefold()
    if own in _OPEN_WORDS:
        return "broken", None
    return "open", own


def defect_of(question: str | None, answer: str | None, by_design: bool) -> tuple[str | None, str | None]:
    """(defect, None), or (None, word) if the answer is sound unless it ends at a word that no sentence ends with."""
    if is_empty(answer):
        return "empty", None
    if is_refusal(answer):
        return (None if by_design else "refusal"), None
    if is_copy(question, answer):
        return "copy", None
    ending, word = ending_of(answer)
    if ending == "broken":
        return "truncated", None
    if differs(question, answer):
        return "language", None
    return None, word


#: The share of a word's uses that end a sentence or line, over all words, and the share below which no answer ends at it.
USUAL_SHARE, LEAST_SHARE = 0.08, 0.001
_WORD_OR_END = re.compile(r"[^\W\d_]+|[.!?。！？]|\n")


def _count_ends(text: str, mid: Counter, ends: Counter) -> None:
    """Counts for each word how often another word follows (mid) and how often it ends a sentence or line (ends); the
    last word of the text counts as neither."""
    last = None
    for t in _WORD_OR_END.findall(_CITATION.sub("", text).casefold()):
        if t[0].isalpha():
            if last is not None:
                mid[last] += 1
            last = t
        elif last is not None:
            ends[last] += 1
            last = None


def message_pairs(messages: DataFrame) -> DataFrame:
    """pair_id, question, answer, by_design of each assistant message with the last user message before it in its chat
    (at equal times the user's comes first). No user message before it, or no chat or time: no pair.

    Within slots of time a window carries the question on; an answer whose slot has none yet gets the last one of the
    chat's earlier slots, which come from one small row a slot. So a chat of any size is spread over its slots.
    """
    kept = messages.select("id", "chat_id", "created_at", "received_at", clean_role(F.col("role")).alias("role"), "content", "abstained")
    rows = latest_deliveries(kept, ["chat_id", "created_at", "role", "content", "abstained"]).filter("chat_id is not null and created_at is not null and role in ('user', 'assistant')").withColumn("slot", slot_of(F.col("created_at")))
    asked = F.when(F.col("role") == "user", F.struct(F.col("content").alias("content")))
    first = F.when(F.col("role") == "user", 0).otherwise(1)
    w = Window.partitionBy("chat_id", "slot").orderBy("created_at", first, "id").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("q", F.last(asked, ignorenulls=True).over(w)).filter("role = 'assistant'")
    ends = rows.groupBy("chat_id", "slot").agg(F.max_by(asked, F.when(F.col("role") == "user", F.struct("created_at", "id"))).alias("last_q"))
    before = ends.withColumn("carried", F.last("last_q", ignorenulls=True).over(Window.partitionBy("chat_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).filter("carried is not null").select("chat_id", "slot", "carried")
    have = inner.filter("q is not null")
    miss = inner.filter("q is null").drop("q").join(before, ["chat_id", "slot"]).withColumnRenamed("carried", "q")
    return have.unionByName(miss).select(F.col("id").alias("pair_id"), F.col("q.content").alias("question"), F.col("content").alias("answer"), (F.lower(strip_white(F.coalesce("abstained", F.lit("")))) == "yes").alias("by_design"))


def question_pairs(questions: DataFrame) -> DataFrame:
    """The golden set as pairs; repeated rows count once."""
    return questions.select(F.col("id").alias("pair_id"), "question", "answer", F.coalesce(F.lower(strip_white(F.col("case_type"))) == "no-answer", F.lit(False)).alias("by_design")).distinct()


def judge_pairs(pairs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """pair_id and defect (null for sound pairs) of each pair: 'empty', 'refusal' (unless by design), 'copy',
    'truncated' or 'language', the first that holds.

    A null or blank question can't be copied and has no language. An answer whose last list item, or a short answer
    that, stops without a full stop is 'truncated' too if its last word ends a sentence or line in less than ``least_share`` of its uses in
    all answers, or if it is a short piece of a word that occurs nowhere else. The share starts from that of all words,
    as if seen once, so few uses tell nothing, and more rows of the same kind change no verdict that rests on enough of
    them. Repeated pair ids give one row each.
    """

    names = ["pair_id", "defect", "word", "mid", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, questions, answers, designs = (c.to_pylist() for c in b.columns)
            found = [defect_of(q, a, bool(d)) for q, a, d in zip(questions, answers, designs)]
            mid, ends = Counter(), Counter()
            for a in answers:
                if a:
                    _count_ends(a, mid, ends)
            words = list(mid.keys() | ends.keys())
            none = [None] * len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, *none], pa.string()), pa.array([*(x for x, _ in found), *none], pa.string()), pa.array([*(w for _, w in found), *words], pa.string())]
                + [pa.array([*[None] * len(ids), *(c[w] for w in words)], pa.int64()) for c in (mid, ends)], names=names
            )

    judged = pairs.select("pair_id", "question", "answer", "by_design").mapInArrow(run, "pair_id string, defect string, word string, mid long, ends long")
    # verdicts and the words' counts come from one pass, which is written once and read for both
    judged = materialize(judged, "pairs-judged")
    verdicts = judged.filter("mid is null").select("pair_id", "defect", "word")
    ends = judged.filter("mid is not null").groupBy("word").agg(F.sum("mid").alias("mid"), F.sum("ends").alias("ends"))
    return _with_ends(verdicts, ends, least_share)


def _with_ends(judged: DataFrame, ends: DataFrame, least_share: float) -> DataFrame:
    known = judged.filter("word is null").select("pair_id", "defect")
    asked = judged.filter("word is not null").join(ends, "word", "left")
    n_ends, uses = F.coalesce("ends", F.lit(0)), F.coalesce("ends", F.lit(0)) + F.coalesce("mid", F.lit(0))
    broken = F.when(uses == 0, F.length("word") <= 6).otherwise((n_ends + USUAL_SHARE) / (uses + 1) < least_share)
    return known.unionByName(asked.select("pair_id", F.when(broken, "truncated").alias("defect")))


def defective_pairs(questions: DataFrame, messages: DataFrame) -> DataFrame:
    """pair_id and defect of the defective pairs of the golden set and of the chats."""
    return judge_pairs(question_pairs(questions).unionByName(message_pairs(messages))).filter("defect is not null")
