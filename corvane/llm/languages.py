"""The language of short texts by script and by profiles of character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache, lru_cache

# For each language Article 1 of the Universal Declaration of Human Rights and common words.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in is that it for was on are with as his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two him see than its after who does did must only because while until before",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn was wer welche kann muss wann warum dieser keine gibt bevor während",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec elle son aux sa mais comme ou on ont été leur cette ses était fait nous être peut ces vous tout deux si sans quand où dont quel quelle lorsque après avant doit pendant pourquoi comment même chaque aussi",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué cuál cómo quién dónde cada debe puede antes después donde hay",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas esse eles você qual pode deve cada antes",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. di e il la che in un a per è una sono non con si da come del le dei della nel alla più ha al anche i lo gli ma o se questo cui delle dal stato ci era essere nella tra suo quando loro dopo prima perché quale chi ogni deve può fino senza",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de van het een en in is dat op te zijn met voor niet aan er die om ook als maar dan bij uit door over naar hij wordt ze nog heeft hun tot deze geen was wel kan moet meer worden wat wie waarom wanneer omdat voordat totdat elke",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. och i att det som en på är av för med den till inte om har de ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket måste varför vem vilken innan",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. i w na z się nie do to że jest o od po jak za przez dla są ale czy co tak być lub tym przy oraz który która które może tylko już jego ich bez pod nad gdy kiedy dlaczego kto każdy musi przed",
}
#: Scripts of one or few languages, as ranges of letters.
SCRIPTS = {"cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽἀ-῿", "arabic": "؀-ۿ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ", "thai": "฀-๿", "hangul": "가-힯ᄀ-ᇿ", "kana": "ぁ-ヿ", "han": "㐀-鿿豈-﫿"}
_SCRIPTS = {name: re.compile(f"[{letters}]") for name, letters in SCRIPTS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_JOINED = re.compile(r"\S*[^\W_][-_/.@][^\W_]\S*|\S*\d\S*")
LONGEST = 5


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(padded) - n + 1)]


def _words(text: str) -> list[str]:
    return [part for w in _WORD.findall(text.casefold().replace("’", "'")) for part in re.split(r"['-]", w) if part]


@cache
def profiles() -> dict[str, dict[str, float]]:
    """For each n-gram of ``SAMPLES`` and each language the smoothed log odds against the mean of all languages."""
    counts = {k: Counter(g for w in _words(text) for g in _grams(w)) for k, text in SAMPLES.items()}
    known, smooth = set().union(*counts.values()), 0.3
    totals = {k: sum(c.values()) + smooth * len(known) for k, c in counts.items()}
    mean = {g: sum((counts[k][g] + smooth) / totals[k] for k in counts) / len(counts) for g in known}
    # longer n-grams say more, and they overlap with the shorter ones
    return {g: {k: len(g.strip()) * math.log((counts[k][g] + smooth) / totals[k] / mean[g]) for k in counts} for g in known}


@lru_cache(maxsize=200_000)
def _word_scores(word: str) -> dict[str, float]:
    table = profiles()
    grams = [table[g] for g in _grams(word) if g in table]
    n = max(1, len(_grams(word)))
    return {k: sum(g[k] for g in grams) / n for k in SAMPLES}


def script_of(text: str) -> str | None:
    """The script that is not Latin of a fifth or more of the letters ('kana' for Japanese, which has Han letters too)."""
    letters = sum(c.isalpha() for c in text)
    if not letters or text.isascii():
        return None
    found = {name: n for name, pattern in _SCRIPTS.items() if (n := len(pattern.findall(text)))}
    if found.get("kana"):
        found["kana"] += found.pop("han", 0)
    if not found:
        return None
    name, n = max(found.items(), key=lambda x: x[1])
    return name if n >= 0.2 * letters else None


def scores(text: str) -> tuple[dict[str, float], int]:
    """The score of each language for a text in Latin letters, by distinct word, and their number. Names with joints,
    numbers and codes are left out."""
    words = set(_words(_JOINED.sub(" ", text)))
    total = dict.fromkeys(SAMPLES, 0.0)
    for w in words:
        for k, x in _word_scores(w).items():
            total[k] += x
    return total, len(words)


#: By how much another language must explain an answer better than the question's own, and by how much a question's
#: best language must lead to be its only one. Sound pairs stay below 2, answers in another language come from 9 up.
MARGIN, LEAD = 5.0, 0.2


def differs(question: str | None, answer: str | None) -> bool:
    """Whether the answer is written in another language than the question: in another script, or explained better by
    another language's profile than by those of all languages the question may be in. Texts that don't tell differ
    from none; Japanese may be written in Han letters alone."""
    if not question or not answer:
        return False
    asked, said = script_of(question), script_of(answer)
    if asked or said:
        if asked == said or not any(c.isalpha() for c in question) or not any(c.isalpha() for c in answer):
            return False
        if {asked, said} == {"kana", "han"}:
            return asked == "kana" and len(_SCRIPTS["han"].findall(answer)) >= 20
        # a name or code in Latin letters is no language
        return bool(said) if asked is None else said is not None or scores(answer)[1] >= 3
    own, n = scores(question)
    if not n:
        return False
    best = max(own.values())
    theirs, _ = scores(answer)
    top = max(theirs.values())
    return all(top - theirs[k] >= MARGIN for k, x in own.items() if best - x < LEAD)
