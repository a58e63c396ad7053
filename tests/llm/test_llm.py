"""Training-data operators on small tables: results, edge cases, and brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.llm import encoding, leakage, lookalikes, mixing, personal, sentences, splitting, subjects
from textloom.llm.common import add_column, once_texts

ITEM = "src string, doc_id string, id string, text string"
EDGE = [("segment", "d", "null", None), ("segment", "d", "empty", ""), ("pdf_page", "d", "blank", " \n "), ("segment", None, None, "no key"), ("segment", "d", "again", "Same."), ("segment", "d", "again", "Same.")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, ITEM)


# ---- 1 ----------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "word " * 200, "x" * 500, "żółć 漢字😀 " * 60, "Line one.\n\nLine two, and more; end.\n" * 30, "é" * 300])
@pytest.mark.parametrize(("limit", "overlap"), [(100, 10), (37, 0), (50, 40), (5, 1)])
def test_split_covers_within_limit(text, limit, overlap):
    spans = splitting.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
    assert all(len(text[a:b].encode()) <= limit for a, b in spans)


def test_split_prefers_natural_boundaries():
    text = "First sentence here. Second sentence here. Third one ends.\n\n" + "More text follows now. " * 3
    cuts = [text[:b] for _, b in splitting.split_spans(text, 70, 20)][:-1]
    assert cuts[0].endswith("ends.\n\n") and all(c[-1].isspace() for c in cuts)


def test_split_items(spark, edge):
    limits = spark.createDataFrame([("segment", 10, 2), ("other", None, None)], "src string, max_bytes int, overlap_bytes int")
    more = edge.unionByName(spark.createDataFrame([("segment", "d", "long", "x" * 1000), ("pdf_page", "d", "free", "y" * 50)], ITEM)).withColumn("piece", F.lit("clash"))
    got = {(r.src, r.id): r.pieces for r in splitting.split_items(more, limits).collect()}
    assert len(got["segment", "long"]) > 100 and len(got["pdf_page", "free"]) == 1
    assert got["segment", "null"][0].piece is None and got["segment", "empty"][0].piece == ""
    assert splitting.split_items(more.limit(0), limits).count() == 0


# ---- 2 ----------------------------------------------------------------------

CHANGED = [
    ("Ｗｉｄｅ １２", "Wide 12"), ("𝐁𝐨𝐥𝐝", "Bold"), ("conﬁrmed", "confirmed"), ("ǳień", "dzień"), ("café", "café"), ("in​side", "inside"), ("a­b", "ab"), ("two words here", "two words here"),
    ("Вiegły podpisał", "Biegły podpisał"), ("Fаktura nr", "Faktura nr"), ("memο", "memo"), ("пpиёмки до срока", "приёмки до срока"), ("we рау the fee", "we pay the fee"), ("1⁠5 szt.", "15 szt."),
    ("the ꓮꓢꓔ of it", "the AST of it"), ("signed bу Օwen", "signed by Owen"), ("the ᏢᎪᎷ test", "the PAM test"), ("sᴍᴀʟʟ ᴄᴀᴘs", "small caps"), ("раѕѕword", "password"),
]
KEPT = ["α-Wert", "PDF-копия и USB-ключ", "Дом построен в XIX в. и требует ремонта.", "«Это» — “да”…", "OK 👨‍👩‍👧 ✅ 👍🏽", "借主は第197条（案）を、確認しました！", "डॉ. साहब 11 बजे आए।", "партии AB-4281.2 и KX1324-7", "Γράψτε στο nora@post.example ή 555-0159 ext. 05", "l'été – ça va", "", "plain", "Հայերեն տեքստ է", "the word /bɪt/ and [ʀɪt]", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ꓡꓲ‐ꓢꓴ"]


@pytest.mark.parametrize(("text", "want"), CHANGED)
def test_lookalikes_change(text, want):
    assert lookalikes.unify(text) == want
    assert lookalikes.unify(want) == want


@pytest.mark.parametrize("text", KEPT)
def test_lookalikes_keep(text):
    assert lookalikes.unify(text) == unicodedata.normalize("NFC", text)


def test_lookalike_offsets_lead_back():
    text = "Ｊ​an memό x"
    new, src = lookalikes.unify_mapped(text)
    assert new == "Jan memó x" and text[src[new.index("x")]] == "x" and len(src) == len(new)


def test_lookalike_items(spark, edge):
    df = edge.unionByName(spark.createDataFrame([("segment", "d", "x", t) for t, _ in CHANGED], ITEM)).withColumn("unified2", F.lit(1))
    got = lookalikes.unify_items(df)
    assert got.columns == ["src", "doc_id", "id", "unified", "unified2"] and got.count() == len(EDGE) + len(CHANGED)
    assert sorted(r.unified for r in lookalikes.changed_items(df).collect()) == sorted(w for _, w in CHANGED)


def test_lookalikes_of_two_other_scripts_leave_the_jvm(spark):
    texts = ["Дοговор подписан до срока", "Договор подписан ò вчера", "Договор подписан"]
    want = [lookalikes.unify(t) for t in texts]
    assert want[0] == "Договор подписан до срока"
    df = spark.createDataFrame([("segment", "d", str(k), t) for k, t in enumerate(texts)], ITEM)
    assert {r.id: r.unified for r in lookalikes.unify_items(df).collect()} == {str(k): w for k, w in enumerate(want)}
    assert {r.id for r in lookalikes.changed_items(df).collect()} == {str(k) for k, (t, w) in enumerate(zip(texts, want)) if t != w}


# ---- 3 ----------------------------------------------------------------------

MENTIONS = [
    ("Proszę o kontakt z Zofią Modnicką, adres tomasz.brzezynski@mail.invalid, tel. (22) 077-62-43.", [("name", "Zofią Modnicką"), ("email", "tomasz.brzezynski@mail.invalid"), ("phone", "(22) 077-62-43")]),
    ("Tożsamość ustalono na podstawie: PESEL 942 803 442 08. Faktura nr 57 i zamówienie 702364143 dotyczą partii AB-7145.2.", [("id_number", "942 803 442 08")]),
    ("Identity was checked against passport ZZ0010647.", [("id_number", "ZZ0010647")]),
    ("Przesyłkę nadano na adres os. Cicha Przystań 85 m. 27, 00-016 Łąkowiec.", [("address", "os. Cicha Przystań 85")]),
    ("Mr. Imogen Halerly lives at 413 Old Kiln Lane, Unit 34, Mill Otter, ZZ 00015.", [("name", "Imogen Halerly"), ("address", "413 Old Kiln Lane")]),
    ("Pytania kierować na biuro(at)kancelaria(dot)example.", [("email", "biuro(at)kancelaria(dot)example")]),
    ("Spółka Veskon S.A. (KRS 705362316, NIP 000-632-03-26) wpłaciła wadium.", []),
    ("Zofi​a Modnicka, tel. +48 22 023 03 62", [("name", "Zofi​a Modnicka"), ("phone", "+48 22 023 03 62")]),
    ("[OSOBA_1] i **** w dniu 2018-05-16", []),
]


@pytest.mark.parametrize(("text", "want"), MENTIONS)
def test_mentions(text, want):
    got = personal.mentions(text)
    assert [(k, a) for k, a, _ in got] == [(k, text.index(t)) for k, t in want]


@pytest.mark.parametrize(
    ("text", "names"),
    [("霧崎恒一郎さんが2019年に受け取りました。", ["霧崎恒一郎"]), ("確認しました。柏ノ木透子さんが来た。", ["柏ノ木透子"]), ("佐藤さくらさんが来た。", ["佐藤さくら"]), ("昨日田中一郎様が", ["田中一郎"]), ("第二の付属書です。\n-- \n東雲寺美砂緒\nbiuro@post.example", ["東雲寺美砂緒"]), ("雪村沢颯馬", ["雪村沢颯馬"]), ("担当者様", []), ("図面二部", []), ("総則", []), ("たくさん", [])],
)
def test_japanese_names(text, names):
    assert [text[a:b] for k, a, b in personal.mentions(text) if k == "name"] == names


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("请联系王伟，邮箱 a@post.example。", ["王伟"]), ("请联系阚雨桐，电话。", ["阚雨桐"]), ("陈建国于2018年签收。", ["陈建国"]), ("今天，欧阳娜娜签署了合同。", ["欧阳娜娜"]), ("林若溪", ["林若溪"]),
        ("今天早上陈建国确认了合同。", ["陈建国"]), ("数字不对！赵明检查了报告。", ["赵明"]), ("李四先生已签署。", ["李四"]), ("决定。\n-- \n郁墨白\na@post.example", ["郁墨白"]), ("承包商确认了合同。", []), ("图纸两份", []), ("总则", []), ("安全检查", []),
    ],
)
def test_chinese_names(text, names):
    assert [text[a:b] for k, a, b in personal.mentions(text) if k == "name"] == names


@pytest.mark.parametrize(
    ("text", "want"),
    [("npm i lodash@4.17.21 now", []), ("5 @ 3.50 each", []), ("def f @app.route", []), ("git@host.example:team/repo.git", []), ("write to biuro @ post.example", ["biuro @ post.example"]), ("Kowalski Sp. z o.o. wpłaciła wadium.", []), ("Mr. Xyrb Qwontle lives at", ["Xyrb Qwontle"]), ("The Hague", []), ("Main Street Bakery", [])],
)
def test_names_and_mails_can_be_rejected(text, want):
    assert [text[a:b] for _, a, b in personal.mentions(text)] == want


@pytest.mark.parametrize(("text", "want"), [("anna (małpa) firma (kropka) pl", "anna (małpa) firma (kropka) pl"), ("Пришлите на улица Тверская 15, 101000.", "улица Тверская 15"), ("Adresse: Im Winkel 7a / 3", None), ("Er wohnt Am Lindenhof 12/4.", "Am Lindenhof 12")])
def test_no_gate_before_the_generators(text, want):
    m = personal.model()
    spans = [text[a:b] for k, a, b, _ in personal.candidates(text, m["lex"], m["ends"], {}) if k in ("email", "address")]
    assert spans and (want is None or want in [text[a:b] for _, a, b in personal.mentions(text)])


REAL = [
    ("Mrs. Emily Johnson signed.", ["Emily Johnson"]), ("Mr. John Smith lives here", ["John Smith"]), ("contact Emily Johnson", ["Emily Johnson"]), ("Sr. Carlos Pérez firmó", ["Carlos Pérez"]), ("María García vive en Madrid", ["María García"]),
    ("Звонил Дмитрий Иванов", ["Дмитрий Иванов"]), ("Please ask Wei Zhang about it.", ["Wei Zhang"]), ("Ο Γιώργος Παπαδόπουλος υπέγραψε", ["Γιώργος Παπαδόπουλος"]), ("कृपया राहुल शर्मा से संपर्क करें", ["राहुल शर्मा"]), ("اتصل بـ محمد علي", ["محمد علي"]), ("ติดต่อ สมชาย ใจดี", ["สมชาย ใจดี"]), ("श्री विनोद ठाकुर ने", ["विनोद ठाकुर"]),
    ("Adres: Krótka 5, Kraków", ["Krótka 5"]), ("Mieszka przy Marszałkowska 10, Warszawa", ["Marszałkowska 10"]), ("She lives at 221B Baker Street, London.", ["221B Baker Street"]), ("ул. Ленина 15, Москва", ["ул. Ленина 15"]),
    ("Der Vertrag wurde am Montag in Berlin unterschrieben.", []), ("The Board of Directors met on Monday in London.", []), ("Payment and Delivery", []), ("डॉ. साहब 361 बजे आए।", []), ("Faktura nr 55 i zamówienie 705562922", []),
]


@pytest.mark.parametrize(("text", "want"), REAL)
def test_mentions_of_no_training_text(text, want):
    assert [text[a:b] for _, a, b in personal.mentions(text)] == want


def test_redaction_leaves_the_rest(spark, edge):
    df = edge.unionByName(spark.createDataFrame([("segment", "d", f"m{k}", t) for k, (t, _) in enumerate(MENTIONS)], ITEM))
    got = {r.id: (r.text, r.redactions) for r in personal.redact(df).collect()}
    assert got["null"] == (None, 0) and got["empty"] == ("", 0)
    assert got["m0"][0].startswith("Proszę o kontakt z [NAME], adres [EMAIL], tel. [PHONE]")
    assert got["m2"][0] == "Identity was checked against passport [ID_NUMBER]."
    assert got["m6"] == (MENTIONS[6][0], 0)
    assert personal.mention_rows(df).distinct().count() == sum(len(w) for _, w in MENTIONS)


# ---- 4 ----------------------------------------------------------------------

UNITS = [
    (False, "Kto to zatwierdził?|Proszę wstrzymać wypłatę!|Cena, tj. ok. 5 zł, wzrosła.|Koniec."),
    (False, "135. Inspektor opieczętował rejestr.|No cóż... kwoty się nie zgadzają!"),
    (False, "“Is this final?” asked the chair, and nobody answered.|He wrote, \"Send it by Friday.\"|The U.S. office opens at 2 a.m. on working days."),
    (False, "Der 2. Bauabschnitt beginnt am 15. Oktober.|Das Büro in St. Lohwald öffnet um 3 Uhr."),
    (False, "誰が承認しましたか。|「いつ払いますか。」と担当者は尋ねた。|数字が合いません！"),
    (False, "“这是最后的决定吗？”主席问道。|数字不对！"),
    (False, "ตัวเลขไม่ถูกต้อง|ผู้เช่าส่งใบแจ้งหนี้แล้ว"),
    (False, "पृष्ठ 238 देखें।|डॉ. साहब 11 बजे आए।"),
    (False, "Ποιος το ενέκρινε;|Η επιτροπή έλεγξε."),
    (False, "من وافق على ذلك؟|رفض المدير العقد."),
    (False, "Done! 👍🏽|Next one."),
    (False, "List of Defects\n|• proof of payment\n|2) keys to room 9"),
    (True, "List of Defects\n|The tenant rejected the repair estimate before the\ndeadline. |The board copied it and then it was forwarded, see\nart. 54, to the office."),
]


@pytest.mark.parametrize(("layout", "marked"), UNITS)
def test_units(layout, marked):
    parts = marked.split("|")
    glue = "" if any("　" <= c <= "鿿" for c in marked) or "\n" in marked else " "
    text = glue.join(parts)
    s = sentences.unit_starts(text, layout)
    got = [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)])]
    assert got == [p.strip() for p in parts]


def test_units_tile(spark, edge):
    df = edge.unionByName(spark.createDataFrame([("pdf_page" if l else "segment", "d", f"u{k}", t.replace("|", " ")) for k, (l, t) in enumerate(UNITS)], ITEM))
    rows = sentences.sentence_units(df).orderBy("id", "unit_no").collect()
    texts = {r.id: r.text for r in df.collect()}
    for i in {r.id for r in rows}:
        own = [r for r in rows if r.id == i]
        assert "".join(r.unit for r in own).replace(" ", "").replace("\n", "") == texts[i].replace(" ", "").replace("\n", "")
    assert {r.id for r in sentences.sentence_starts(edge).collect()} == {None, "again"}


# ---- 5 ----------------------------------------------------------------------

CLEAN = "Kierownik budowy potwierdził protokół odbioru w dwóch egzemplarzach. Zespół archiwum podpisał świadectwo jakości."


@pytest.mark.parametrize(("was", "read_as"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1250", "latin-1"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp852", "cp1252")])
def test_encoding_restored(was, read_as):
    bad = "".join(encoding.decoder(read_as)[b] for b in CLEAN.encode(was))
    text, steps, lost = encoding.repair(bad)
    assert text == CLEAN and steps and not lost


@pytest.mark.parametrize(
    ("text", "was", "read_as"),
    [("Документ подписан в двух экземплярах.", "cp1251", "latin-1"), ("Документ подписан", "koi8-r", "latin-1"), ("承認しました。書類を確認してください。", "cp932", "cp1252"), ("合同已经签署,请确认。", "gbk", "latin-1"), ("Το τιμολόγιο επιβεβαιώθηκε", "cp1253", "latin-1"), ("Größe und Maß für die Tür", "cp1252", "cp850")],
)
def test_encoding_of_other_alphabets(text, was, read_as):
    bad = "".join(encoding.decoder(read_as)[b] for b in text.encode(was))
    new, steps, _ = encoding.repair(bad)
    assert new == text and steps


@pytest.mark.parametrize("text", ["Ärger über die Größe", "Việt Nam đã ký hợp đồng với công ty", "Çalışma ücreti ödendi", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Árvíztűrő tükörfúrógép", "ÁÉÍÓÚ", "àéèù", "한국어 문장", "caf&eacute; &amp; bar"])
def test_encoding_of_other_languages_left_alone(text):
    assert encoding.repair(text)[:2] == (text, [])


def test_encoding_offsets_are_exact():
    clean = "Żółć i “gęś” – 12 €, naprawdę"
    bad = "ok &amp; "[:3] + "".join(encoding.decoder("cp1252")[b] for b in clean.encode()) + "\nzwykła linia"
    new, src = encoding.repair_mapped(bad)
    assert new == f"ok {clean}\nzwykła linia"
    at = 3
    for c in clean:
        assert src[new.index(clean) + clean.index(c)] <= at + 400
    for k, c in enumerate(clean):
        assert src[3 + k] == 3 + len("".join(encoding.decoder("cp1252")[b] for b in clean[:k].encode()))


def test_encoding_twice_and_in_part():
    twice = "".join(encoding.decoder("cp1252")[b] for b in "".join(encoding.decoder("cp1252")[b] for b in CLEAN.encode()).encode())
    assert encoding.repair(twice)[0] == CLEAN
    part = CLEAN + "\n" + "".join(encoding.decoder("latin-1")[b] for b in CLEAN.encode())
    new, steps, _ = encoding.repair(part)
    assert new == f"{CLEAN}\n{CLEAN}" and steps
    back, src = encoding.repair_mapped(part)
    assert back == new and src[-1] == len(part) - 1


@pytest.mark.parametrize("text", [CLEAN, "It’s the owner’s copy — don’t lose it. Price: £55 ± £93.", "├── pisma\n│   └── projekt.txt", "NÃO HÁ INFORMAÇÃO SOBRE A SITUAÇÃO.", "Þykktin er 84 ± 6.910,92 mm, sjá ¶ 184.", "Der Prüfer, « Est-ce définitif ? » ¿Quién?", "借主は確認しました。", "Кто это утвердил?", "", None, "plain &amp; simple"])
def test_encoding_left_alone(text):
    assert encoding.repair(text) == (text, [], False)


def test_encoding_table(spark):
    df = spark.createDataFrame([("a", None), ("b", "lost m�re"), ("c", "krÃ³tkiej rozmowie po krÃ³tkiej"), ("d", "")], "doc_id string, text string")
    got = {r.doc_id: r.repaired for r in encoding.repair_encoding(df).collect()}
    assert got["a"].text is None and got["b"].lost and got["c"].text == "krótkiej rozmowie po krótkiej" and got["d"].steps == []


# ---- 6 ----------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    passages = [" ".join(rnd.choices(vocab, k=40)) for _ in range(6)]
    items = spark.createDataFrame([(k, p) for k, p in enumerate([*passages, passages[0], None, "", "too short"])], "item_id bigint, passage string")
    rows, want = [], set()
    for n in range(60):
        k, share = rnd.randrange(6), rnd.choice([0.0, 0.3, 0.7, 1.0])
        words = passages[k].split()[: int(40 * share)]
        if words and n % 3 == 0:
            words[len(words) // 2] = "changed"
        noise = lambda: " ".join(rnd.choices(vocab, k=20))
        text = f"{noise()}. <p>{', '.join(words).upper()}</p>\n{noise()}"
        rows.append((n, text))
        if share >= 0.5:
            want |= {(n, i) for i in ([0, 6] if k == 0 else [k])}
    rows += [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("leaks", F.lit("clash"))
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == want
    clean = {r.doc_id: r.text for r in leakage.without_leaks(docs, items).collect()}
    assert set(clean) == {n for n, _ in want} and leakage.leaked_items(spark.createDataFrame(list(clean.items()), "doc_id bigint, text string"), items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_every_copy_of_a_passage_is_cut_out(spark):
    p = [f"word{k}x" for k in range(40)]
    second = [*p[:1], "changed", *p[2:]]
    hyphen = " ".join(p).replace("word7x", "wo-\nrd7x").replace("word9x", "wo\u200brd9x")
    items = spark.createDataFrame([(1, " ".join(p))], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, f"Before it. {' '.join(p)} Between them stands this. {' '.join(second)} After it."), (2, f"Before it. {hyphen} After it.")], "doc_id bigint, text string")
    clean = {r.doc_id: " ".join(r.text.split()) for r in leakage.without_leaks(docs, items).collect()}
    assert clean == {1: "Before it. Between them stands this. After it.", 2: "Before it. After it."}
    assert leakage.words("wo\u200brd co-\noperate")[0] == ["word", "cooperate"]


def test_passage_with_every_third_word_changed(spark):
    p = [f"word{k}x" for k in range(30)]
    changed = ["other" if k % 3 == 2 else w for k, w in enumerate(p)]
    added = [x for k, w in enumerate(p) for x in ([w, "more"] if k % 3 == 2 else [w])]
    items = spark.createDataFrame([(1, " ".join(p))], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(added)), (3, " ".join(p[:10]))], "doc_id bigint, text string")
    assert {r.doc_id for r in leakage.leaked_items(docs, items).collect()} == {1, 2}


# ---- 7 ----------------------------------------------------------------------


def test_mixture(spark, tmp_path):
    rows = [(k, "word " * (1 + k % 7), "Big " if k % 2 else "BIG") for k in range(400)] + [(1000 + k, "tiny text here", "small") for k in range(5)] + [(2000, None, "big"), (2001, "x", None), (2002, "x", "other"), (2003, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeat int")
    m = mixing.Mixture(docs, targets)
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["small"].used_tokens == 45 and shares["small"].most_copies == 3 and shares["gone"].used_tokens == 0
    assert abs(shares["big"].actual_share - 7 / 9) < 0.03
    records = m.records.collect()
    assert len({r.doc_id for r in records}) == len(records) and max(r.copies for r in records if r.source == "big") == 1
    again = mixing.Mixture(docs.orderBy(F.rand()), targets).records
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, records))
    assert mixing.Mixture(docs.limit(0), targets).records.count() == 0


# ---- 8 ----------------------------------------------------------------------

DOC = "doc_id bigint, text string, source string, post_type string, thread_id bigint, title string, tags array<string>"


def test_subjects(spark):
    rows = [
        (1, "Does the null pointer come from the merge conflict? I tried to revert the commit and to mock the database.\n\nBy the way, my neighbour only talks about the oven temperature.", "x", "question", 1, "How do I debug the callback?", ["pointer"]),
        (2, "Thanks, that worked!", None, "answer", 1, None, None),
        (3, "Last week I had to knead the dough and blanch the beans, the risotto rice was fine.\n\nAll I want is to appeal the ruling without the tenancy deposit.", "x", "question", 3, "Best way to draft a will without harming the puff pastry?", []),
        (4, None, None, "question", 4, None, None),
        (5, "", None, None, None, "", None),
    ]
    docs = spark.createDataFrame(rows, DOC).withColumn("subject", F.lit("clash"))
    areas = spark.createDataFrame([(s,) for s in "science law sport software health finance cooking travel history music gardening motoring meta".split()], "subject string")
    labels = spark.createDataFrame([(3, " Law ", "a"), (3, None, "b"), (1, "cooking", "tool"), (99, "law", "a")], "doc_id bigint, subject string, labeler string")
    got: dict = {}
    for r in subjects.assign(docs, labels, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got[1] == got[2] == {"software"}
    assert got[3] == {"law", "cooking"}
    assert len(got[4]) == len(got[5]) == 1
    assert subjects.assign(docs.limit(0), labels, areas).count() == 0


def test_latent_model_learns_who_is_right():
    rnd = random.Random(1)
    counts: dict = {}
    for _ in range(4000):
        y = rnd.random() < 0.4
        good = y if rnd.random() < 0.95 else not y
        poor = y if rnd.random() < 0.55 else not y
        other = y if rnd.random() < 0.9 else not y
        key = (int(good), int(poor), int(other))
        counts[key] = counts.get(key, 0) + 1
    start = [[[0.6, 0.4]] * 3, [[0.4, 0.6]] * 3]
    theta, base = subjects.learn(counts, start, 200)
    assert abs(base - 0.4) < 0.08 and theta[1][0][1] > 0.8 > theta[1][1][1]  # the prior pulls a little
    assert subjects.posterior((1, 0, 1), theta, base) > 0.9


def test_plain_characters_are_never_suspect():
    import re

    plain = [chr(k) for k in range(0x2100) if re.fullmatch(f"[{lookalikes.PLAIN}]", chr(k))]
    assert len(plain) > 500 and not [c for c in plain if re.match(lookalikes.SUSPECT, c) or re.match(lookalikes.OTHER, c)]


def test_a_number_and_its_unit_stay_together():
    text = "ราคา 50 บาท ผู้เช่าลงนามแล้ว"
    assert "บาท ผู้เช่าลงนามแล้ว" not in [text[a:] for a in sentences.unit_starts(text, False)]
    assert text.index("ผู้") in sentences.unit_starts(text, False)


def test_repeated_items_count_once(spark):
    rows = [("segment", f"d{k}", "s0", f"text {k}") for k in range(500)] + [("segment", f"d{k}", "s0", f"text {k}") for k in range(0, 500, 7)] + [("segment", None, None, "x"), ("segment", None, None, "x")]
    df = spark.createDataFrame(rows, ITEM)
    got = once_texts(df).collect()
    assert len(got) == 501 and len({(r.doc_id, r.id) for r in got}) == 501
    assert once_texts(df.limit(0)).count() == 0 and once_texts(df.filter("doc_id = 'd1'")).count() == 1


def test_added_columns_keep_the_others(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(1, "a", [1, 2], {"k": "v"})], "n int, text string, xs array<int>, m map<string,string>")
    got = add_column(df, "size", "int", lambda ts: pa.array([len(t) for t in ts], pa.int32()))
    assert got.columns == ["n", "xs", "m", "size"] and got.first().size == 1
