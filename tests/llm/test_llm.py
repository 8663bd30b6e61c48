import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import conversations, history, packing, pairs, spam, splitting, tokens

TEXTS = ["", None, "plain text", "日本語と emoji 👩‍🚀 <|endoftext|>", "x" * 3000, "\r\n\t ", "ÄÖÜß" * 50, "plain text"]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("extra", F.lit(1))
    ids = tokens.encode_texts(df, keep=["doc_id"])
    rows = {r.doc_id: r.ids for r in ids.collect()}
    assert rows[0] == [] and rows[1] == [] and rows[2] == rows[7] and 50256 not in rows[3]
    assert {r.doc_id: r.text for r in tokens.decode_ids(ids).collect()} == {n: t or "" for n, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.encode_texts(df, keep=["doc_id"], counts=True).collect()} == {k: len(v) for k, v in rows.items()}
    assert tokens.encode_texts(df.limit(0), keep=["doc_id"]).count() == 0
    spans = tokens.char_offsets(TEXTS[3], rows[3])
    assert spans[0][0] == 0 and spans[-1][1] == len(TEXTS[3]) and all(a[0] <= b[0] for a, b in zip(spans, spans[1:]))
    assert tokens.decode(rows[3][:5]).startswith("日")


def test_byte_table():
    table = tokens.byte_chars()
    assert len(set(table.values())) == 256 and table[ord("A")] == "A" and table[0] == "Ā" and table[32] == "Ġ"


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=120))
def test_fill_respects_limits(items):
    limits = np.array([50, 6, 60])
    sizes = np.array([[a, 1, b] for a, b in items], np.int64).reshape(-1, 3)
    bins = packing.fill(sizes, limits)
    assert (bins >= 0).all()
    for b in set(bins.tolist()):
        assert (sizes[bins == b].sum(axis=0) <= limits).all()


def test_fill_of_vectors_and_bad_items():
    with pytest.raises(ValueError):
        packing.fill(np.array([[51, 1, 1]]), np.array([50, 6, 60]))
    assert packing.fill(np.empty((0, 3)), np.array([50, 6, 60])).tolist() == []
    # segments and loss within the tokens' limits decide nothing
    assert packing.binding(np.array([[5, 1, 5], [9, 1, 2]]), np.array([10, 10, 10])) == [0]
    rng = np.random.default_rng(0)
    tokens = np.clip(rng.lognormal(5.2, 1.0, 3000), 5, 2048).astype(int)
    sizes = np.stack([tokens, np.ones(3000, int), np.clip(tokens * rng.beta(2, 2, 3000), 1, 1200).astype(int)], axis=1)
    limits = np.array([2048, 16, 1200])
    bins = packing.fill(sizes, limits)
    assert all((np.bincount(bins, weights=sizes[:, d]) <= limits[d]).all() for d in range(3))
    assert bins.max() + 1 <= 1.03 * np.ceil(sizes.sum(axis=0) / limits).max()


def test_instruction_items(spark):
    df = spark.createDataFrame([("a", "one two", "three"), ("b", None, "x"), ("c", "y", None), ("d", None, None)], "pair_id string, question string, answer string")
    got = {r.pair_id: (r.n_tokens, r.n_loss) for r in packing.instruction_items(df).collect()}
    assert got["b"][0] == got["b"][1] > 0 and got["c"][1] == 0 and got["d"] == (0, 0) and got["a"][0] > got["a"][1] > 0


def test_packing(spark):
    rng = random.Random(3)
    sizes = [None, 0, 100, 100, 250, 7] + [rng.randint(1, 60) for _ in range(400)]
    df = spark.createDataFrame([(n if n != 5 else None, s) for n, s in enumerate(sizes)], "doc_id int, n_tokens int").withColumn("item", F.lit("clash")).withColumn("row", F.lit(1))
    got = packing.pack(df, "doc_id", capacity=100).collect()
    room = {}
    for r in got:
        if r.container_id:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    total = sum(s or 0 for s in sizes)
    assert max(room.values()) <= 100 and sum(room.values()) == total and len(room) <= total / 100 * 1.02 + 1
    parts = sorted((r.piece_no, r.start_token, r.n_tokens) for r in got if r.doc_id == 4)
    assert parts == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(sum(r.doc_id == n for r in got) == 1 for n in range(len(sizes)) if n not in (4, 5)) and [r.container_id for r in got if r.doc_id in (0, 1)] == [None, None]
    assert packing.pack(df.limit(0), "doc_id", capacity=100).count() == 0
    assert {r.container_id[0] for r in got if r.container_id} <= set("fgs") and "l" not in got[0].asDict()
    few = packing.pack(df, "doc_id", capacity=100, max_segments=2).filter("container_id is not null").groupBy("container_id").count()
    assert few.agg(F.max("count")).first()[0] == 2


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab .\n。! ", max_size=400), st.integers(30, 60))
def test_pieces_are_whole_and_bounded(text, limit):
    text = text.strip()
    spans, forced = splitting.pieces_of(text, limit, 10)
    assert "".join(text[f:e] for _, f, e in spans) == text and all(e - s <= limit for s, _, e in spans)
    longest = max(map(len, re.split(r"[\s。！？]", text)))
    assert not forced or longest + 1 > limit
    for (a, _, b), (s, f, _) in zip(spans, spans[1:]):
        assert a <= s <= f == b


def test_splitting_cases(spark):
    chunks = [("c1", "h", "word " * 300), ("c1", "h", "word " * 300), ("c2", None, "z" * 851), ("c3", "h", None), ("c4", "h", "  " + "q" * 850 + "　"), ("c5", "h", ""), ("c6", None, "あ。" * 600)]
    documents = [("d", [(1, "H", "line one\n" * 200), (2, None, None)]), ("e", None), ("f", [])]
    d = spark.createDataFrame(documents, "id string, processed_sections array<struct<page:int,heading:string,text:string>>").withColumn("text", F.lit("clash"))
    c = spark.createDataFrame(chunks, "id string, heading string, text string").withColumn("item_id", F.lit("clash"))
    got = {r.item_id: r for r in splitting.oversized_items(d, c).collect()}
    assert {k: r.cut for k, r in got.items()} == {"c1": "boundary", "c2": "forced", "c6": "boundary", "d#0": "boundary"}
    assert got["d#0"].heading == "H" and all(p.text.endswith("\n") or p.stop == got["d#0"].n_chars for p in got["d#0"].pieces)
    second = got["c1"].pieces[1]
    assert second.text.startswith("word") and 140 <= second.fresh - second.start <= 150
    assert splitting.oversized_items(d.limit(0), c.limit(0)).count() == 0


REFUSAL = "I'm sorry, but I can't help with that. Please ask the owner."
QUESTION = "Who owns the frozen service account?"


@pytest.mark.parametrize(
    ("question", "answer", "design", "defect"),
    [
        (QUESTION, None, False, "empty"), (QUESTION, "​ [1]", False, "empty"), (QUESTION, "N/A", False, "empty"), (QUESTION, "No.", False, None), (None, None, True, "empty"),
        (QUESTION, REFUSAL, False, "refusal"), (QUESTION, REFUSAL, True, None), (QUESTION, 'The Sable crew. Others see "I can\'t help with that".', False, None), ("¿Qué es?", "Lo siento, no puedo responder a esa pregunta.", False, "refusal"),
        (QUESTION, "**WHO OWNS THE FROZEN SERVICE ACCOUNT**", False, "copy"), (QUESTION, f"Q: {QUESTION}\nA:", False, "copy"), (QUESTION, f"{QUESTION} {QUESTION}", False, "copy"), (QUESTION, f"{QUESTION} The Sable crew.", False, None),
        (QUESTION, "It belongs to the Sable crew. Since April the", False, "truncated"), (QUESTION, "It belongs to the crew [1", False, "truncated"), (QUESTION, "Run\n```bash\nls", False, "truncated"), (QUESTION, "1. It waits.\n2.", False, "truncated"), (QUESTION, "- one item\n- the other one", False, None),
        (QUESTION, "Sie gehört der Gruppe und wird von ihr verwaltet.", False, "language"), ("Was bedeutet der Fehler?", "Er bedeutet, dass die Quelle nicht da ist.", False, None), (None, "It is kept for 3 days.", False, None),
    ],
)
def test_pair_defects(question, answer, design, defect):
    assert pairs.defect_of(question, answer, design)[0] == defect


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (QUESTION, "I can't rotate it; the Sable crew owns it.", None), (QUESTION, "We lack a second owner.", None), (QUESTION, "We do not share tokens between workspaces.", None), (QUESTION, "The cache cannot answer this request.", None), (QUESTION, "We decline requests over 30 rows.", None),
        (QUESTION, "This assistant is forbidden from discussing the matter.", "refusal"), (QUESTION, "That falls outside what can be discussed here.", "refusal"), (QUESTION, "I am unable to assist with this request.", "refusal"), (QUESTION, "I cannot answer.", "refusal"), ("Quem é?", "Não posso responder a essa pergunta.", "refusal"),
        (QUESTION, f"{QUESTION} " * 61, "copy"), (QUESTION, f"{QUESTION} " * 5, "copy"), ("Refund?", "Refund?", "copy"), (QUESTION, f"{QUESTION} Sable.", None), (QUESTION, f"Here is what you asked me about, as far as I understand the message above: {QUESTION}", "copy"),
        (QUESTION, f"The Sable crew owns it and rotates it on Mondays: {QUESTION}", None), ("Is the cache frozen or idle?", "The cache is idle.", None), (QUESTION, "who owns a frozen service account", "copy"), (QUESTION, "x " * 20000 + "y.", None),
        (QUESTION, "A conta pertence à equipe e é gerida por ela.", "language"), (QUESTION, "该帐户属于团队。", "language"), (QUESTION, "Учётная запись принадлежит команде.", "language"), (QUESTION, "L'account appartiene al gruppo e viene gestito da loro.", "language"), ("アカウントの所有者は誰ですか。", "It belongs to the crew that keeps the lock.", "language"),
        ("アカウントの所有者は誰ですか。", "Sable Crew", None), ("Wem gehört das Konto?", "Osprey-router", None), ("Can they reset it?", "No.", None), ("?!", "It belongs to the Sable crew.", None),
    ],
)
def test_copies_refusals_and_languages_by_alignment(question, answer, defect):
    assert pairs.defect_of(question, answer, False)[0] == defect


def test_common_subsequence_against_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs._common(a, b) == (table[-1][-1], table[-1][-2])


@pytest.mark.parametrize(
    ("answer", "ending"),
    [
        ("It is raised by bramble-archiver whe", ("broken", None)), ("Sorry for the mix-up earlier. It p", ("broken", None)), ("Ask the Lantern group first, then r", ("broken", None)), ("Yes, but only until the storage admin", ("broken", None)), ("It was moved on 1", ("broken", None)),
        ("List the settings of m", ("open", "m")), ("Die Sperre endet nach", ("open", "nach")), ("The B", ("open", "b")), ("the Sable crew", ("open", "crew")), ("n", ("open", "n")),
        ("Osprey-router", ("whole", None)), ("Sable Crew", ("whole", None)), ("No", ("whole", None)), ("yes", ("whole", None)), ("TMR-6920", ("whole", None)), ("30 [1]", ("whole", None)),
    ],
)
def test_short_endings(answer, ending):
    assert pairs.ending_of(answer) == ending


def test_short_answers_by_the_use_of_their_last_word(spark):
    known = [(f"k{n}", QUESTION, "The Sable crew nach dem Sperren. It belongs to the Sable crew.", False) for n in range(100)]
    asked = [("cut", "Wann endet die Sperre?", "Die Sperre endet nach", False), ("piece", QUESTION, "The B", False), ("whole", QUESTION, "the Sable crew", False), ("name", QUESTION, "Osprey-router", False)]
    df = spark.createDataFrame(known + asked, "pair_id string, question string, answer string, by_design boolean")
    assert {r.pair_id: r.defect for r in pairs.judge_pairs(df).collect() if r.pair_id[0] != "k"} == {"cut": "truncated", "piece": "truncated", "whole": None, "name": None}


def test_verdicts_by_share_at_any_size(spark):
    schema = "pair_id string, question string, answer string, by_design boolean"
    # 'frozen' ends a line by chance once in some 2,000 uses, 'queue' now and then, 'relay' in one of 50; 'drift' is seen too seldom to tell
    known = ["The frozen queue waits. " * 100] * 20 + ["It is frozen", "It waits for the queue. The queue of relay runs. " * 5, "The relay is up. " * 49 + "See the relay.", "The drift is old. " * 2]
    asked = {"cut": "1. It waits.\n2. It reports the frozen", "noun": "1. It waits.\n2. It reports the queue", "rare": "1. It waits.\n2. It reports the relay", "few": "1. It waits.\n2. It reports the drift"}
    for times in (1, 10):
        rows = [(f"k{n}", QUESTION, a + ".\n", False) for n, a in enumerate(known * times)] + [(k, QUESTION, a, False) for k, a in asked.items()]
        got = {r.pair_id: r.defect for r in pairs.judge_pairs(spark.createDataFrame(rows, schema)).collect() if r.pair_id in asked}
        assert got == {"cut": "truncated", "noun": None, "rare": None, "few": None}


def test_pairs_of_messages(spark):
    ts = lambda s: f"2025-01-01 00:{s:02d}:00"
    rows = [
        ("u1", "c", "User", QUESTION, None, ts(1), 1), ("a1", "c", "bot", "It is", "no", ts(1), 1), ("a1", "c", "bot", "", "no", ts(1), 2), ("a2", "c", "ai", REFUSAL, " YES ", "2025-01-01 05:00:00", 1), ("a3", "d", "ai", "", None, ts(1), 1),
        ("a4", None, "ai", "", None, ts(2), 1), ("u5", "e", "human", None, None, ts(1), 1), ("a5", "e", "model", None, None, ts(2), 1), ("a6", "e", "model", "", None, None, 1),
    ]
    m = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, abstained string, at string, received_at int").withColumn("created_at", F.to_timestamp("at"))
    q = spark.createDataFrame([("q1", "lookup", QUESTION, "TODO"), ("q1", "lookup", QUESTION, "TODO"), ("q2", "no-answer", QUESTION, REFUSAL), ("q3", None, None, None)], "id string, case_type string, question string, answer string")
    assert sorted(map(tuple, pairs.defective_pairs(q, m).collect())) == [("a1", "empty"), ("a5", "empty"), ("q1", "empty"), ("q3", "empty")]
    assert {r.pair_id: r.question for r in pairs.message_pairs(m).collect()} == {"a1": QUESTION, "a2": QUESTION, "a5": None}
    assert pairs.defective_pairs(q.limit(0), m.limit(0)).count() == 0


def test_chats(spark):
    turns = {"good": "uaua", "start": "aua", "end": "uau", "twice": "uuaa", "blank": "ua", "role": "ua", "system": "sua", "only": "s", "unlisted": "ua"}
    rows = []
    for chat, roles in turns.items():
        for n, r in enumerate(roles):
            content = "​" if chat == "blank" and n == 1 else "x"
            role = "moderator" if chat == "role" and n == 1 else {"u": " USER", "a": "Assistant", "s": "tool"}[r]
            rows.append((f"{chat}{n}", chat, role, content, f"2025-01-01 {n * 3:02d}:00:00", 1))
    rows += [("t1", "tie", "bot", "x", "2025-01-01 00:00:00", 1), ("t2", "tie", "user", "x", "2025-01-01 00:00:00", 1), ("n1", "notime", "user", "x", None, 1), ("n2", "notime", "bot", "x", "2025-01-01 00:00:00", 1), ("z", None, "user", "x", "2025-01-01 00:00:00", 1), ("good0", "good", "user", None, "2025-01-01 00:00:00", 0)]
    m = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, at string, received_at int").withColumn("created_at", F.to_timestamp("at")).withColumn("slot", F.lit(9))
    chats = spark.createDataFrame([(c,) for c in [*turns, "tie", "notime", "nomessages", "good", None] if c != "unlisted"], "id string")
    verdicts = {r.chat_id: r.kept for r in conversations.chat_verdicts(chats, m).collect()}
    assert {k for k, v in verdicts.items() if v} == {"good", "system", "tie"} and len(verdicts) == len(turns) + 3
    got = conversations.conversations(chats, m, gap_seconds=4 * 3600).filter("chat_id = 'good'").orderBy("turn_no").collect()
    assert [(r.session_no, r.turn_no, r.role) for r in got] == [(1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"), (1, 4, "assistant")]
    assert conversations.conversations(chats, m, gap_seconds=3600).filter("chat_id = 'good'").agg(F.max("session_no")).first()[0] == 2
    assert conversations.chat_verdicts(chats.limit(0), m.limit(0)).count() == 0
    for gap in (0.5, 3600.0, 1e9):  # whole chats don't depend on where sessions are cut
        assert {r.chat_id for r in conversations.chat_verdicts(chats, m, gap).filter("kept").collect()} == {"good", "system", "tie"}
    by_session = conversations.conversations(chats, m, gap_seconds=4 * 3600, whole_chats=False).collect()
    assert {r.chat_id for r in by_session} == {"good", "system", "tie", "role", "unlisted"} and [r.role for r in by_session if r.chat_id == "role"] == ["user", "assistant"]


def test_sessions_and_calibrated_gap(spark):
    hours = [0, 0.01, 0.02, 0.03, 30, 30.01, 61, 61.02, 61.03, 61.04]  # short pauses within, long ones between
    roles = ["u", "a", "u", "a", "u", "u", "u", "a", "u", "a"]
    rows = [(f"{c}{n}", c, {"u": "user", "a": "bot"}[r], "x", 1.7e9 + h * 3600 + k, 1) for k, c in enumerate("pqrs") for n, (h, r) in enumerate(zip(hours, roles))]
    m = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, s double, received_at int").withColumn("created_at", F.timestamp_seconds("s"))
    instants = conversations._instants(conversations.turns_of(m))
    gap = conversations.calibrated_gap(instants)
    assert 200 < gap < 20 * 3600
    sessions = {(r.session_no, r.turns, r.reciprocal) for r in conversations.sessions_of(instants, gap).filter("chat_id = 'p'").collect()}
    assert sessions == {(1, 4, True), (2, 2, False), (3, 4, True)}
    chats = spark.createDataFrame([("p",)], "id string")
    assert conversations.conversations(chats, m).count() == 0, "one session lacks its reply"
    left = conversations.conversations(chats, m, whole_chats=False).filter("chat_id = 'p'").orderBy("turn_no").collect()
    assert [(r.session_no, r.turn_no, r.role) for r in left] == [(s, n + 1, "user" if n % 2 == 0 else "assistant") for n, s in enumerate([1] * 4 + [3] * 4)]
    assert conversations.calibrated_gap(instants.limit(0)) == float("inf")


def test_spam(spark):
    manual = "The cache keeps the lock for 30 seconds and then releases it. If the queue grows past 20 entries, the broker drains it. "
    rows = [
        (1, "cheap lamp, best lamp, cheap lamp online, lamp price, best lamp, lamp review\n" * 8), (2, "https://a.example/x\nhttp://www.b.test/y\n" * 9), (3, "SKU 12-AB | red lamp | bright | in stock\nSKU 13-AC | old lamp | dim | in stock\n" * 9), (4, "Buy lamp now, lamp for every desk lamp from 20. Find lamp 3, compare lamp, order lamp today. " * 9),
        (5, manual * 5), (6, "- [the cache](https://a.example/x): it keeps the lock for the time that a reader needs it.\n" * 6), (7, None), (8, ""), (9, "```\nlamp lamp lamp lamp\n```\n" + manual), (10, manual * 4 + "cheap lamp, best lamp, lamp price\n"), (11, "監査記録が読み取れないことを示します。再試行枠を確認し、索引を更新します。" * 4), (12, "q" * 5000 + " " + manual),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("spam_share", F.lit("clash"))
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == [1, 2, 3, 4]
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_spam_of_sentences_that_repeat_a_phrase(spark):
    fill = "who {0} in the {1} and for that {2} but before the {3} then {4} with {5} until {6}"
    things = ["desk lamp", "wall clock", "tea tray", "coat rack"]
    words = [f"word{n}" for n in range(2000)]
    page, rest = [], iter(words)
    for n in range(24):
        thing = things[n % 4]
        own = [next(rest) for _ in range(7)]
        page.append(f"The {thing} " + fill.format(own[0], thing, own[1], own[2], thing, own[3], own[4]) + ".")
    lines = [f"{t}, best {t}, {t} price" for t in things] * 4
    plain = ["The {} waits for the {} before it is read by a {} of the {}.".format(*[next(rest) for _ in range(4)]) for _ in range(16)]
    rows = [(1, " ".join(page)), (2, "\n".join([*lines, *page[:6], *plain[:6]])), (3, " ".join(plain))]
    assert sorted(r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id int, text string")).collect()) == [1, 2]


def test_spam_is_told_by_shapes(spark):
    tags = "\n".join(f"#{a}{b}" for a in ("Warm", "cold", "Old") for b in ("Lamp", "clock", "Tray", "rack"))
    assert spam.spam_share(tags)[0] == 1.0 and spam.spam_share(tags)[1] <= 3
    # many keywords, each in a few stuffed sentences or phrases: no keyword is a large part of the page
    things = [f"thing{n} part{n}" for n in range(34)]
    stuffed = " ".join(f"Buy {t} now, {t} for every {t} from 20. Find {t} 3, compare {t}, order {t} today." for t in things)
    phrases = "\n".join(f"{t} {t} cheap {t} best {t}" for t in things)
    assert spam.spam_share(stuffed)[0] > 0.5 and spam.spam_share(phrases)[0] > 0.5
    glossary = "\n".join(f"- The {t} keeps the lock for a reader and then releases it to the next one in the queue." for t in things)
    assert spam.spam_share(glossary)[0] == 0.0
    # what decides is the shape: with one shape for all, no page is told from another
    page = spam.Page([])
    first, second = (spam.shape_of(spam.Unit("line", x), page) for x in ("red lamp, best lamp, old lamp, lamp price", "tin tray, good tray, big tray, tray cost"))
    assert first == second and not spam.is_sentence(first)
    quoted = "> | Key | Owner |\n> | --- | --- |\n> | a_b | one team |\n" * 9
    assert spam.spam_share(quoted)[0] == 0.0 and spam.spam_share("買い物、特価、買い物、特価、買い物、特価、買い物、特価、買い物、特価\n" * 5)[0] > 0.5


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _brute(rows):
    kept, out = [], set()
    for r in sorted({x for x in rows if x[1] and x[4] and x[0]}, key=lambda x: (x[2] or 0, x[3], x[0])):
        words = re.findall(r"[^\W_]+", r[4].lower())
        if not words:
            continue
        hits = [k for k, g, w in kept if g == r[1] and 10 * _edits(w, words) <= max(len(w), len(words))]
        out |= {(r[0], k) for k in hits}
        if not hits:
            kept.append((r[0], r[1], words))
    return out


def test_history_against_brute_force(spark, window=2):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(25, 60))]
        for copy in range(rng.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
            rows.append((f"i{n}-{copy}", f"g{n % 3}", rng.choice([0, 0, 1, 2]), copy, " ".join(words)))
    rows += [("s1", "g0", 0, 0, "Short text"), ("s2", "g0", 1, 0, "short, TEXT!"), ("s3", "g1", 1, 0, "short text"), ("n1", "g0", 1, 0, None), ("n2", None, 1, 0, "short text"), (None, "g0", 1, 0, "short text"), ("b", "g0", 1, 0, " 　"), rows[0]]
    df = spark.createDataFrame(rows, "id string, guest_id string, batch_no int, chunk_index int, text string").withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("h", F.lit("clash")).withColumn("code", F.lit(0))
    got = set(map(tuple, history.repeated_chunks(df, window=window).collect()))
    expected = _brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
    # keys are lost by chance only: at least nine links of ten, in fact all of these
    assert {a for a, _ in got} == {a for a, _ in expected} and got <= expected and len(got) >= 0.99 * len(expected)


@pytest.mark.parametrize("window", [2, 32])
def test_wide_blocks_give_every_accepted_chunk(spark, window):
    rng = random.Random(7)
    rows = []
    for n in range(6):
        base = [f"v{n}x{k}" for k in range(60)]

        def edited(places, tag, base=base):
            return " ".join(f"{tag}{p}" if p in places else w for p, w in enumerate(base))

        # 'a' and 'b' are 8 edits apart, so both are accepted; the cases of 'mid' repeat both, those of 'near' only 'a'
        far = rng.sample(range(60), 8)
        rows += [(f"a{n}", "g", 0, 0, edited([], "")), (f"b{n}", "g", 0, 1, edited(far, f"far{n}x"))]
        rows += [(f"mid{n}-{k}", "g", 1, k, edited(far[:4], f"far{n}x") + f" mid{k}") for k in range(4)]
        rows += [(f"near{n}-{k}", "g", 1, 9 + k, edited([], "") + f" near{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "id string, guest_id string, batch_no int, chunk_index int, text string").withColumn("created_at", F.lit(None).cast("timestamp"))
    got = set(map(tuple, history.repeated_chunks(df, window=window).collect()))
    expected = {(f"mid{n}-{k}", f"{kept}{n}") for n in range(6) for k in range(4) for kept in "ab"} | {(f"near{n}-{k}", f"a{n}") for n in range(6) for k in range(40)}
    assert got == expected


def test_later_copies_repeat_what_came_between(spark):
    base = [f"w{n}" for n in range(40)]
    make = lambda tag, places: " ".join(f"{tag}{p}" if p in places else w for p, w in enumerate(base))
    x, b = make("m", (3, 9)), make("m", (3, 9, 20, 30, 38))
    nine = "one two three four five six seven eight nine"
    rows = [("a", 0, 0, make("", ())), ("x1", 1, 0, x), ("b", 1, 1, b), ("x2", 1, 2, x), ("x3", 2, 0, x), ("n1", 0, 1, nine), ("n2", 1, 3, nine + " ten")]
    df = spark.createDataFrame([(i, "g", n, c, t) for i, n, c, t in rows], "id string, guest_id string, batch_no int, chunk_index int, text string").withColumn("created_at", F.lit(None).cast("timestamp"))
    expected = [("n2", "n1"), ("x1", "a"), ("x2", "a"), ("x2", "b"), ("x3", "a"), ("x3", "b")]
    assert sorted(map(tuple, history.repeated_chunks(df).collect())) == expected


def _chunk_rows(spark, rows):
    return spark.createDataFrame([(i, g, b, 0, t) for i, g, b, t in rows], "id string, guest_id string, batch_no int, chunk_index int, text string").withColumn("created_at", F.lit(None).cast("timestamp"))


def test_history_goes_on_in_a_new_object(spark, tmp_path):
    base = " ".join(f"w{n}" for n in range(30))
    folder = f"file://{tmp_path}/history"
    open_again = lambda: history.AcceptedHistory(spark, folder, max_runs=2)
    assert open_again().add(_chunk_rows(spark, [("a", "g", 0, base)])).count() == 0
    found = open_again().add(_chunk_rows(spark, [("b", "g", 1, base + " x"), ("c", "g", 1, base), ("d", "g", 1, "other " * 12)]))
    assert sorted(map(tuple, found.collect())) == [("b", "a"), ("c", "a")]
    # a batch that broke off: its rows lie in the tables, but no manifest tells of them
    broken = open_again()
    broken.classes.append(broken.classes.frames()[0].drop("run").withColumn("rep", F.lit("ghost")).withColumn("h", F.lit(1).cast("long")), 77)
    broken.classes.close()
    store = open_again()
    assert store.add(_chunk_rows(spark, [])).count() == 0 and len(store.state["runs"]) == 1, "the third run has been merged"
    assert store.state["gone"] == [] and sum(df.count() for df in store.accepted()) == 2 and sum(df.count() for df in store.entries.frames()) == 2 * history.KEYS
    store.classes.close(), store.entries.close()
    found = open_again().add(_chunk_rows(spark, [("e", "g", 3, base + " y"), ("f", "g", 3, "other " * 13)]))
    assert sorted(map(tuple, found.collect())) == [("e", "a"), ("f", "d")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_")]


def test_a_batch_reads_and_adds_in_proportion(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(30))
    texts = {(g, k): text() for g in range(100) for k in range(20)}
    store = history.AcceptedHistory(spark, f"file://{tmp_path}/history")
    store.add(_chunk_rows(spark, [(f"a{g}-{k}", f"g{g}", 0, t) for (g, k), t in texts.items()]))
    # one workspace in a hundred brings a batch of 1 %: 10 new texts and 10 changed ones
    batch = _chunk_rows(spark, [(f"b{k}", "g7", 1, text()) for k in range(10)] + [(f"c{k}", "g7", 1, texts[7, k] + " more") for k in range(10)])
    part = batch.select(F.pmod(F.xxhash64("guest_id"), F.lit(history.PARTS)).alias("p")).first().p
    (base,) = store.entries.frames([part])
    plan = base._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and base.count() < 0.3 * 2000 * history.KEYS
    merged, counts = store._merged, []
    store._merged = lambda *x: counts.append((out := merged(*x)).count()) or out
    assert sorted(map(tuple, store.add(batch).collect())) == [(f"c{k}", f"a7-{k}") for k in range(10)]
    runs = store.entries.frames()
    assert runs[0].count() == 2000 * history.KEYS and runs[1].count() == 20 * history.KEYS and store.state["runs"][1:]
    # all that was sorted is the blocks that a record of the batch shares with another
    assert 0 < counts[0] <= 2 * 20 * history.KEYS


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 30), min_size=10, max_size=80), st.data())
def test_sketches_never_lose_a_repetition(words, data):
    other = list(words)
    for _ in range(data.draw(st.integers(0, len(words) // 10))):
        other[data.draw(st.integers(0, len(other) - 1))] = data.draw(st.integers(31, 60))
    a, b = (history.code_of([f"w{x}" for x in w], {}) for w in (words, other))
    x, y = history.sketches([a, b]).tolist()
    assert history._may_repeat(x, y)
