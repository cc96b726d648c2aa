"""Defective pairs and text kinds."""

import numpy as np
import pytest

from textloom.llm import pairs as P
from textloom.llm import quality as Q

ASK = "How do I restart the token cache when node7 reports E1234?"


@pytest.mark.parametrize(
    "query, response, defect",
    [
        (ASK, None, "empty"), (ASK, " \n", "empty"), (ASK, "N/A", "empty"), (ASK, "```\n```", "empty"), (ASK, "​", "empty"), (ASK, "<br>", "empty"),
        (ASK, ASK, "copy"), (ASK, f"> {ASK.upper()}", "copy"), (ASK, f"You asked: {ASK[:-1].lower()}.", "copy"), (ASK, f"{ASK} {ASK}", "copy"), ("错误E1的根本原因是什么？", "您问的是：错误E1的根本原因是什么.", "copy"),
        (ASK, f"{ASK}\n\nStop the service first and start the cache again.", None), (ASK, f"{ASK} No.", None),
        (ASK, "I'm sorry, but I can't help with node7.", "refusal"), (ASK, "Je suis désolé, je ne peux pas répondre à cette demande.", "refusal"), (ASK, "i won't provide steps for this request", "refusal"),
        (ASK, "I'm sorry to hear that. Stop the service and start the cache again.", None), (ASK, "I cannot say which replica failed first, but this works. Start the cache again.", None),
        (ASK, "Stop the service and then the", "truncated"), (ASK, "Use this:\n\n```sh\ncache stop", "truncated"), (ASK, "1. stop\n2. start\n3.", "truncated"), (ASK, "Once the cache has been stopped (", "truncated"), (ASK, "| a | b |\n|---|---|\n| 1 |", "truncated"),
        (ASK, "Nach dem Neustart ist der Zwischenspeicher wieder leer und die Anfragen sind nicht mehr blockiert.", "other_language"), (ASK, "重启之后缓存就会被清理。", "other_language"),
        (ASK + " Answer in German.", "Nach dem Neustart ist der Zwischenspeicher wieder leer und die Anfragen sind nicht mehr blockiert.", None),
        (ASK, "No.", None), (ASK, "4.2.1", None), (ASK, "`cache stop --id node7`", None), (ASK, "- stop cache\n- start cache", None), (ASK, "| a | b |\n|---|---|\n| 1 | 2 |", None), (None, "It works again after a restart of the cache.", None), ("", "Es ist wieder leer.", None),
    ],
)
def test_defects(query, response, defect):
    assert P.defect(query, response) == defect


# Phrasings that were written without looking at the tables.
PROMPTS = {"en": "How do I restart the token cache when node7 reports E1234?", "de": "Wie starte ich den Dienst neu, wenn der Knoten nicht mehr antwortet?", "fr": "Comment redémarrer le service quand le nœud ne répond plus ?", "es": "¿Cómo reinicio el servicio cuando el nodo ya no responde?", "zh": "节点没有响应时如何重启服务？"}
HELD_OUT = (
    ("en", 'refusal', ('I refuse.', 'Sorry, no.', 'This request falls outside my scope.', 'I would rather not go into this.', "I'm afraid I won't be able to help with that.", 'We are not permitted to share this.', 'As your assistant I am not allowed to discuss it.', 'That is beyond my capabilities.', 'I have no idea.', 'I prefer not to comment on this.', 'I am not in a position to answer that question.', 'Unfortunately I could not tell you.', "I'm declining to respond.", 'There is insufficient information to give an answer.', 'I never provide such details.', "Apologies, but I'm not willing to explain this.")),
    ("de", 'refusal', ('Dazu möchte ich nichts sagen.', 'Ich verweigere die Antwort.', 'Das kann ich Ihnen leider nicht erklären.', 'Entschuldigung, nein.', 'Ich darf darauf nicht eingehen.', 'Das liegt außerhalb meiner Möglichkeiten.', 'Wir können dazu keine Auskunft geben.', 'Dabei kann ich nicht unterstützen.')),
    ("fr", 'refusal', ('Je refuse.', 'Désolé, non.', 'Je préfère ne pas en parler.', 'Cela dépasse mes compétences.', 'Je ne suis pas autorisé à vous répondre.', 'Nous ne pouvons pas fournir ces détails.', 'Je ne souhaite pas commenter.')),
    ("es", 'refusal', ('Me niego.', 'Lo siento, no.', 'Eso queda fuera de mi alcance.', 'No puedo decirle eso.', 'Prefiero no responder.', 'No podemos proporcionar esos datos.', 'No quiero comentar este asunto.')),
    ("zh", 'refusal', ('我拒绝。', '抱歉，我不能透露。', '这不在我的服务范围内。', '恕不解答。', '我不清楚。', '不方便评论。')),
    ("en", 'empty', ('[pending]', 'to be done', 'see above', '{{answer}}', '<your answer here>', '[insert text]', 'not yet available', 'No response given.', 'To be completed', 'tbc', '--', '(placeholder)', 'No data', '同上', 'siehe oben', 'à compléter', 'coming soon.')),
    ("en", 'other_language', ('Il servizio è stato riavviato perché la cache non era più disponibile e il nodo non rispondeva.', 'O serviço não foi reiniciado porque a cache estava cheia e o nó não respondia mais.', 'Сначала остановите службу, затем очистите кэш и запустите её снова.', 'まずサービスを停止してから、キャッシュを再起動してください。', '서비스를 중지한 다음 캐시를 다시 시작하십시오.', 'أوقف الخدمة أولاً ثم أعد تشغيل ذاكرة التخزين المؤقت.', 'De dienst is niet gestart omdat het geheugen vol was en de node niet meer reageerde.')),
    ("de", 'other_language', ('Stop the service first, then clear the cache and start it again.',)),
    ("es", 'other_language', ('O serviço não foi reiniciado porque a cache estava cheia e o nó não respondia mais.',)),
    ("fr", 'other_language', ('Il servizio è stato riavviato perché la cache non era più disponibile.',)),
    ("zh", 'other_language', ('まずサービスを停止してから、キャッシュを再起動してください。', 'Stop the service and then start it again.')),
    ("en", None, ('No.', 'The server refuses connections until the cache has been rebuilt.', 'The node cannot answer requests while the cache is locked, so restart it.', 'I could not reproduce it, but restarting the cache helped.', 'You can not help it with a restart alone; clear the cache.', 'Nothing.', '[1, 2]', 'see node7', 'The cache is not available until node7 restarts.', 'Restart node7 (after midnight).', '<token_cache>restart</token_cache>', 'Non-blocking restart via `cachectl restart --all`.')),
    ("de", None, ('Der Dienst lehnt Verbindungen ab, bis der Cache neu aufgebaut ist.',)),
    ("es", None, ('El nodo no puede responder hasta que se reinicie.',)),
    ("fr", None, ('Le nœud ne peut pas répondre tant que le cache est plein.',)),
    ("zh", None, ('节点无法提供服务，请重启缓存。', '不会，重启后数据仍然可用。')),
)


def test_held_out_phrasings():
    """Of answers in other words than the tables' at least 0.9 get their type, and so do sound ones that look like defects."""
    every = [(lang, want, text) for lang, want, texts in HELD_OUT for text in texts]
    right = [P.defect(PROMPTS[lang], text) == want for lang, want, text in every]
    assert len(every) == 90 and sum(right) / len(right) >= 0.9


def test_suffix_automaton_is_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 12, 2))
        want = [any(b[s:e] in a for s in range(i + 1) for e in range(i + 1, len(b) + 1) if e - s >= 3) for i in range(len(b))]
        assert P.SuffixAutomaton(a).covered(b, 3) == want


def test_pairs_on_rows(spark):
    rows = [(1, "q text here", None, "x"), (1, "q text here", None, "x"), (None, None, "", None), (2, "What is it?", "word " * 50_000 + ".", None)]
    df = spark.createDataFrame(rows, "item_id long, query string, response string, defect string")
    assert {(r.item_id, r.defect) for r in P.defective_pairs(df).collect()} == {(1, "empty"), (None, "empty")}
    assert P.defective_pairs(df.limit(0)).count() == 0


PROSE = "The token cache of node {0} was restarted before the first commit, and the operator noticed that it kept growing. After {0} minutes the service answered again, because the disk was no longer full."
LIST = "- item {0}\n- restart cache\n- node{0}\n- stop {0}\n- other thing"
TABLE = "| a | b |\n|---|---|\n| {0} | 2 |\n| 3 | {0} |"
JUNK = "qX{0}zk#;;w.x{0},v#q;zzk xkq{0}#;.,;"


def sample(spark, lo, hi):
    kinds = (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK))
    rows = [(i, (text.format(i) + " ") * (1 + i % 3) if kind != "table" else text.format(i), "en", kind) for i in range(lo, hi) for kind, text in [kinds[i % 4]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")


def test_kinds_are_learned(spark):
    train, held = sample(spark, 0, 160), sample(spark, 1000, 1080)
    words = spark.createDataFrame([("en", w, 1) for w in "the of and it was that because after".split()] + [(None, None, 1)], "lang string, word string, word_rank int")
    labels = train.select("doc_id", "kind")
    every = train.unionByName(held).drop("kind").unionByName(spark.createDataFrame([(5000, None, None), (5001, "", "en"), (5002, " \n", None), (5003, "x" * 200_000, None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in Q.text_quality(every, labels, words).collect()}
    assert {5000, 5001, 5002}.isdisjoint(got) and 5003 in got
    right = [got[r.doc_id].kind == r.kind for r in held.collect()]
    assert sum(right) / len(right) > 0.95
    r = got[1000]
    assert sum(r.contributions) == pytest.approx(r.distance**2, rel=1e-6) and r.top_stat in Q.STATS


def test_bounded_samples(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    assert Q.bounded_sample(rows, "doc_id", 20_000).count() == 10_000
    few = Q.bounded_sample(rows, "doc_id", 1_000)
    assert 900 < few.count() <= 1_000 and Q.bounded_sample(rows.limit(0), "doc_id", 5).count() == 0


def test_few_texts_of_a_language_draw_on_all(spark):
    """A language's prose moves from that of all languages to its own as its texts grow in number, without a switch; far texts weigh little."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (400, len(Q.STATS)))
    gap = []
    for n in (0, 5, 60, 400):
        own = rng.normal(2, 1, (n, len(Q.STATS)))
        rows = [(x.tolist(), "en") for x in base] + [(x.tolist(), "fr") for x in own] + [(np.full(len(Q.STATS), 500.0).tolist(), "en")] * 4
        found = Q.prose_models(spark.createDataFrame(rows, "x array<double>, lang string"))
        assert np.abs(found["en"].centre).max() < 0.6 and (found["en"].scale < 16).all()
        gap.append(float(found["fr"].centre.mean()) if n else float(found[""].centre.mean()))
    assert gap[0] < gap[1] < gap[2] < gap[3] and gap[3] > 1.6
    assert Q.prose_models(spark.createDataFrame([], "x array<double>, lang string")) == {}


def test_without_labels_all_is_prose(spark):
    d = sample(spark, 0, 4)
    words = spark.createDataFrame([("en", "the", 1)], "lang string, word string, word_rank int")
    out = Q.text_quality(d.drop("kind"), d.select("doc_id", "kind").limit(0), words).collect()
    assert {r.kind for r in out} == {"prose"} and {r.distance for r in out} == {0.0}
