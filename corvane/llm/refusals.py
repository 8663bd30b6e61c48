"""Refusals told by alignment with templates."""

from __future__ import annotations

import re
from functools import lru_cache

# Templates of refusals and of what goes along with them. A template is a sequence of places; a place takes
# any of its words, those with ! must be filled, in order. Japanese and Chinese go character by character.
_ANSWERING = "answer|respond|reply|comment|help|assist|discuss|speak|talk|speculate|guess|answering|responding|commenting|helping|assisting|discussing|speculating"
_GIVING = "provide|share|disclose|fulfil|fulfill|complete|process|offer|give|tell|address|do|say"
_THAT = "that|this|it|your|you|anything|such|one"
TEMPLATES = {
    "en": (
        f"!i|we can|could|will|would|may|must|do|am|are be !not|rather|never be able|allowed|permitted|authorised|authorized|willing|in position to !{_ANSWERING} with|to|on|about {_THAT} question|request|topic|matter",
        f"!i|we can|could|will|would|may|must|am|are be !not be able|allowed|permitted|authorised|authorized|willing to !{_GIVING} !{_THAT} question|request",
        "!i|we do|did|could !not have|find|see enough|sufficient|any|the !information|data|context|details|knowledge|evidence|access to|on answer|respond|help|say",
        "!i|we !lack|am|are|have missing|without|no the|any|enough !information|data|context|details|knowledge|evidence|access to answer|respond|help|say",
        "!i|we must|have|will|would|prefer|need|respectfully to !decline|refuse|abstain|refrain|pass !to|from|this|that|your|on|it|answering answer|request|comment|question|respond",
        "it is !not !possible|permitted|allowed for !me|us|anyone|here to give|provide|share|answer|help|discuss this|that|an answer",
        "!that|this|it|which|question|request|topic|matter|subject is|falls|goes|lies|sits !outside|beyond|past what|the !i|we|me|my|our|be|scope|remit can|may|am|discussed|answered|shared|here discuss|answer|share|help|remit|scope",
        "there is !nothing !i|we can|could|may !tell|say|share|do|answer|add|offer you|on|for about this|that|it",
        "!not !something|anything|topic|question !i|we can|could|may|will !speak|discuss|answer|help|comment|talk|share to|with|about|on",
        "!my|our|these the sources|passages|documents|material|files|data say|says|hold|holds|contain|contains|have !nothing|no|not on|about|answer the|this|that|it|matter|question",
        "!no|without !answer|reply|response|comment from|on !me|us|my|our here|this|side|part",
        "!none|no|nothing of|in the passages|sources|documents|material !settles|answers|covers|supports|addresses this|that|it|question so !i|we leave|can|could|will|must it|not open",
        "so !i|we !leave|keep it|this|that|question !open|unanswered",
        "this|the !assistant|i|bot am|is !not|forbidden|prohibited|barred|unable|restricted|prevented|disallowed allowed|permitted|able from|to !discuss|discussing|answer|answering|comment|commenting|help|helping|respond|responding|talk|talking|disclose|disclosing the|this|that matter|topic|question|subject|it",
        "the|our policy|policies|rules|guidelines|instructions|restrictions !keep|keeps|prevent|prevents|stop|stops|forbid|forbids|bar|bars|prohibit|prohibits !me|us from|to !answering|answer|discussing|discuss|helping|help|commenting|comment|sharing|share|going|getting|saying|speaking|talking about|into|that|this",
    ),
    "de": (
        "dazu|hierzu|darauf|das|diese|leider frage|anfrage !ich|wir|mir|uns kann|können|darf|dürfen|möchte|werde|liegen leider|dazu|hierzu|darauf|das|diese|ihnen|dabei frage|anfrage !nicht|nichts|keine|keinen|kein !beantworten|antworten|helfen|weiterhelfen|sagen|mitteilen|kommentieren|auskunft|angaben|äußern|behilflich|besprechen|informationen geben|sein|vor",
        "!antworte|beantworte|kommentiere !ich|wir das|diese|dazu frage !nicht",
        "es ist !mir|uns leider !nicht|kein !möglich|erlaubt|gestattet zu|das antworten|beantworten|helfen",
        "!das|dies|diese|frage|anfrage geht|liegt|fällt !außerhalb|hinaus|über !was|meiner|meines|unserer|meine|dessen ich|kann|darf zuständigkeit|besprechen|beantworten",
    ),
    "fr": (
        "!je|j|nous|me|m ne peux|puis|suis|souhaite|dois|pouvons|permet en mesure de !pas|rien|aucune|aucun|point vous de !répondre|aider|commenter|fournir|dire|traiter|prononcer|partager|réponse|renseigner|discuter|donner à|sur cette|ce question",
        "!aucun|aucune|rien passage|source|document ne !me|m|nous permet|permettent de !répondre|conclure|dire",
        "!je|nous préfère|dois|souhaite|préférons|me|m !abstenir|abstiens|refuse|décline|refuser|décliner de|cette répondre|demande",
        "!cela|cette|ceci|ce question|demande !dépasse|sort|dehors|hors|relève de ce que !je|nous|mon|mes|notre peux|puis commenter|répondre",
    ),
    "es": (
        "!no me le es !puedo|podemos|debo|quiero|deseo|posible|puede a !responder|responderle|contestar|comentar|ayudar|ayudarle|ayudarte|opinar|decir|decirle|proporcionar|atender|compartir a esa|esta|su|tu pregunta|consulta|solicitud",
        "!no !dispongo|tengo|disponemos|tenemos|cuento de|con !datos|información|acceso|detalles|elementos suficientes|suficiente para responder|contestar",
        "!prefiero|preferimos|debo|tengo que !no|abstenerme|rechazar|declinar responder|contestar|comentar|opinar|esta|la",
        "esta|esa|la consulta|pregunta queda|está|va !fuera|allá|excede de lo que !puedo|podemos|debo|mi|mis|nuestro comentar|responder|contestar|alcance",
    ),
    "pt": ("!não !posso|podemos|consigo|devo !responder|comentar|ajudar|fornecer|dizer a essa|esta|sua pergunta",),
    "it": ("!non !posso|possiamo|sono !rispondere|commentare|aiutare|fornire|aiutarla|aiutarti|grado a questa domanda",),
    "ja": tuple(" ".join(f"!{c}" for c in t) for t in ("お答えできません", "お答えできかね", "お答えいたしかね", "お答えしかね", "お応えでき", "回答できません", "回答できかね", "回答いたしかね", "回答を控え", "回答は控え", "お答えを控え", "お答えは控え", "差し控え", "対応できません", "対応いたしかね", "対応しかね", "お手伝いできません", "お手伝いできかね", "コメントできません", "コメントを控え", "ご案内できません", "お力になれません")),
    "zh": tuple(" ".join(f"!{c}" for c in t) for t in ("无法回答", "不能回答", "无法提供", "无可奉告", "無法回答")),
}
ALONG = (
    "!please|kindly|bitte|veuillez|consulte|consultez|fragen|demandez try|to|instead !ask|contact|consult|check|rephrase|see|reach|try|contacter|reformuler|sie|wenden|con|le|la|with|at|the",
    "!try|consider|perhaps|maybe|you to|may|could|might !rephrase|rephrasing|ask|asking|contact|check|again|later|add|adding|different it|another|a question|document",
    "!sorry|apologise|apologize|apologies|apology|regrettably|unfortunately|afraid|thanks|thank|leider|désolé|désolée|désolés|siento|perdón|lamento|es|tut for|about|i|asking|leid",
    "!you would|want|wish|were|are have|like to !know|asked|asking|ask|wondering|wonder|interested more about|in",
    "!let|feel|happy|glad me|free|to !know|ask|help|reach",
    "!as an|a|your !assistant|ai|model|bot|language",
    "!contact|consult|ask|see your|the|an|a !administrator|admin|owner|team|support|group|documentation|manual|expert|professional",
)
#: How much of a template's weight a sentence must fill; a required place weighs 1, any other PLACE, a word between GAP.
LEAST, PLACE, GAP = 0.6, 0.25, 0.12

_SHORT = ((re.compile(r"\bcan['’]?t\b|\bcannot\b"), "can not"), (re.compile(r"\bwon['’]?t\b"), "will not"), (re.compile(r"\bshan['’]t\b"), "shall not"), (re.compile(r"n['’]t\b"), " not"), (re.compile(r"['’]m\b"), " am"), (re.compile(r"['’]re\b"), " are"), (re.compile(r"['’]d\b"), " would"), (re.compile(r"['’]ve\b"), " have"), (re.compile(r"['’]ll\b"), " will"), (re.compile(r"['’]s\b"), " is"), (re.compile(r"\bunable\b"), "not able"), (re.compile(r"\bimpossible\b"), "not possible"))
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W\d_぀-ヿ㐀-鿿豈-﫿]+")


class Template:
    """A template as sets of words with their weights."""

    def __init__(self, text: str) -> None:
        places = text.split()
        self.words = [frozenset(p.lstrip("!").split("|")) for p in places]
        self.must = [p[0] == "!" for p in places]
        self.required = [w for w, m in zip(self.words, self.must) if m]
        self.total = sum(1.0 if m else PLACE for m in self.must)

    def filled(self, sentence: list[str], known: frozenset[str]) -> float:
        """The share of the template that the best alignment with a stretch of the sentence fills, less its gaps; 0 if a
        required place stays open. A longest common subsequence in which a skipped word of the sentence costs."""
        if not all(w & known for w in self.required):
            return 0.0
        # best[j]: the weight of an alignment of the first j places that ends at the word before
        best = [0.0] + [float("-inf") if any(self.must[:j]) else 0.0 for j in range(1, len(self.words) + 1)]
        found = 0.0
        for word in sentence:
            now = [0.0]
            for j, (words, must) in enumerate(zip(self.words, self.must), 1):
                # skip the word (once begun), skip the place (if it may stay open), or fill it
                value = best[j] - GAP if best[j] > 0 else best[j]
                if not must:
                    value = max(value, now[j - 1])
                if word in words:
                    value = max(value, best[j - 1] + (1.0 if must else PLACE))
                now.append(value)
            best = now
            found = max(found, now[-1])
        return found / self.total


_TEMPLATES = [Template(t) for own in TEMPLATES.values() for t in own]
_ALONG = [Template(t) for t in ALONG]


def words_of(sentence: str) -> list[str]:
    """Lower-case words with contractions written out; kana and ideographs one by one."""
    text = sentence.casefold()
    if "'" in text or "’" in text or "cannot" in text or "able" in text or "possible" in text or "cant" in text:
        for pattern, new in _SHORT:
            text = pattern.sub(new, text)
    return _WORD.findall(text)


@lru_cache(maxsize=100_000)
def refusal_score(sentence: str) -> float:
    """How much of a refusal template the sentence fills, 0 to 1."""
    words = words_of(sentence)
    known = frozenset(words)
    return max((t.filled(words, known) for t in _TEMPLATES), default=0.0)


@lru_cache(maxsize=100_000)
def goes_along(sentence: str) -> bool:
    """Whether a sentence only apologises, thanks or points elsewhere."""
    words = words_of(sentence)
    known = frozenset(words)
    return any(t.filled(words[:8], known) > 0 for t in _ALONG)
