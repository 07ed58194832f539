"""Sentence spans: small texts whose spans are known, and a corpus made of known sentences."""

import random
import time

from terrane.llm import sentences as S

EMPTY = {}


def cut(text, lang="en", models=EMPTY):
    return [text[a:b] for a, b in S.spans(text, lang, models)]


def model(**kinds):
    m = S.Model()
    for k, v in kinds.items():
        setattr(m, k, set(v))
    return m


SRT = "1\n00:00:01,000 --> 00:00:02,000\n{}\n\n2\n00:00:03,000 --> 00:00:04,000\n{}\n\n"


def test_nothing():
    for t in (None, "", " \n", "1\n00:00:01,000 --> 00:00:02,000\n\n", SRT.format("[DOOR SLAMS]", "♪ la la ♪"), "WEBVTT\n\n", "...", "– ?"):
        assert S.spans(t, None, EMPTY) == []


def test_over_lines_and_cues():
    t = SRT.format("Never winter never\nmorning. While roads", "table letters? Rain.")
    assert cut(t) == ["Never winter never\nmorning.", "While roads\n\n2\n00:00:03,000 --> 00:00:04,000\ntable letters?", "Rain."]


def test_notations():
    assert cut("{1}{1}23.976\n{1}{5}And who.") == ["And who."]
    assert cut("WEBVTT\nKind: captions\nLanguage: en\n\n00:01.000 --> 00:02.000\nYes.") == ["Yes."]
    assert cut("{1}{5}And who.|When knows\n{6}{9}went over.") == ["And who.", "When knows\n{6}{9}went over."]
    assert cut("\ufeffWEBVTT\r\n\r\n00:01.000 -> 00:02.000 align:start\r\nOne two.\r\n\r\n00:03.000-->00:04.000\r\nThree.") == ["One two.", "Three."]


def test_markup_dashes_labels():
    t = SRT.format("- <i>Who is that?</i>\n– ULMER: Nobody, sir.", "-No way—\n- Yes.")
    assert cut(t) == ["Who is that?", "ULMER: Nobody, sir.", "No way—", "Yes."]


def test_sounds_part_sentences():
    assert cut("We went (sighs) home. *coughs* Then [Clock ticks. Clock stops.] we slept") == ["We went", "home.", "Then", "we slept"]


def test_masks_of_any_length():
    long = "Clock ticks. " * 60
    for mark in ("[{}]", "({})", "（{}）", "［{}］", "【{}】", "*{}*", '<font face="{}">', "{{\\fn{}}}"):
        assert cut("We went. " + mark.format(long) + " They slept.") == ["We went.", "They slept."], mark
    assert cut("1\n00:00:01,000 " + "x" * 60 + " --> 00:00:02,000\nYes.") == ["Yes."]
    t = SRT.format("We (went home.", "They) slept.")
    assert cut(t)[0] == "We (went home."
    e = S.Evidence()
    e.add(t, "en")
    assert e.raw["en"]["home."] == 1
    began = time.time()
    for c in ("[", "(", "*", "<a ", "{\\", "1:00 -", "♪"):
        S.mask(c * 200_000)
    assert time.time() - began < 20


def test_songs():
    t = SRT.format("♪～\n雨が。\n♪～", "♪ la la ♪ Yes.\n♫ hm\nhm ♫ No. ♪ open end\nWell.")
    assert cut(t, "ja") == ["雨が。", "Yes.", "No.", "Well."]


def test_quotes():
    assert cut('" Garde parce ? " Du vent.', "fr") == ['" Garde parce ? "', "Du vent."]
    assert cut("“Every home!” whispered Halvo. 'All or?' said Pimela. \"Went.\" Who?") == ["“Every home!” whispered Halvo.", "'All or?' said Pimela.", '"Went."', "Who?"]
    assert cut("¿«Una vuelve hacia?» ¡Carta! «La casa,» dijo.", "es") == ["¿«Una vuelve hacia?»", "¡Carta!", "«La casa,» dijo."]
    assert cut("„Weg Brücke.“ »Hause aber?« rief Ferola. »Der Fluss.« Und die.", "de") == ["„Weg Brücke.“", "»Hause aber?« rief Ferola.", "»Der Fluss.«", "Und die."]
    assert cut("« Garde ? » dit Torvel. La clé\xa0! « Où ? » Oui.", "fr") == ["« Garde ? » dit Torvel.", "La clé\xa0!", "« Où ? »", "Oui."]
    assert cut('"Every brat."Brat most. Them.\'Bring me.\' Why?') == ['"Every brat."', "Brat most.", "Them.", "'Bring me.'", "Why?"]


def test_periods():
    m = {"en": model(title=["mr", "dr"], number=["vol"], last=["inc", "p.m"])}
    t = "Before Mrs Dr. Ferola or. A 58.99 broken vol. 34 brother. Us B. D. Besna old. Fell Inc. Or at 5 p.m. Back... please river. It was over... River v2.3 www.a.example is."
    assert cut(t, "en", m) == ["Before Mrs Dr. Ferola or.", "A 58.99 broken vol. 34 brother.", "Us B. D. Besna old.", "Fell Inc.", "Or at 5 p.m.", "Back... please river.", "It was over...", "River v2.3 www.a.example is."]


def test_one_case():
    m = {"en": model(title=["mr"], verb=["said"])}
    assert cut("the mr. besna went. where is \"the over?\" said you. and this.", "en", m) == ["the mr. besna went.", "where is \"the over?\" said you.", "and this."]
    assert cut("THE MR. BESNA WENT. WHERE?! AND THIS.", "en", m) == ["THE MR. BESNA WENT.", "WHERE?!", "AND THIS."]


def test_ordinals():
    assert cut("Und am 18. Juni die Hause. Es ist 5. Und nicht.", "de", {"de": model(ordinal=["juni"])}) == ["Und am 18. Juni die Hause.", "Es ist 5.", "Und nicht."]


def test_scripts():
    assert cut("यह घर है। वह कब? डॉ. हालवो आए।", "xx", {"hi": model(title=["डॉ"])}) == ["यह घर है।", "वह कब?", "डॉ. हालवो आए।"]
    assert cut("Φανάρι ήσυχο; Το πήγε.", None) == ["Φανάρι ήσυχο;", "Το πήγε."]
    assert cut("النهر القديم. أين المصباح؟", None) == ["النهر القديم.", "أين المصباح؟"]
    assert cut("ነገር ጸጥ። ሁሉም የት፧", None) == ["ነገር ጸጥ።", "ሁሉም የት፧"]
    assert cut("Տուն և։ Մենք հին։", None) == ["Տուն և։", "Մենք հին։"]


def test_cues_of_scripts_without_blanks():
    t = SRT.format("风灯笼来。 我们\n旧河", "「来吗？」，说。「好。」再次")
    assert cut(t, "zh") == ["风灯笼来。", "我们\n旧河", "「来吗？」，说。", "「好。」", "再次"]
    assert cut("「来る？」とまた。『雨が。』", "ja") == ["「来る？」とまた。", "『雨が。』"]
    t = SRT.format("บ้าน เก่า?\nไป", "Visit www.a.example for\nmore!")
    assert cut(t, "th") == ["บ้าน", "เก่า?", "ไป", "Visit www.a.example for\nmore!"]


def test_wrongly_decoded_text_is_kept():
    assert cut("×òî êëþ÷. Ãîðîä", "ru") == ["×òî êëþ÷.", "Ãîðîä"]
    assert cut("cl� ferme. �ber sp�t.", "fr")[1].startswith("�ber")


def test_long_text():
    t = "The roads went over. " * 50_000
    got = S.spans(t, "en", EMPTY)
    assert len(got) == 50_000 and t[slice(*got[-1])] == "The roads went over."
    assert len(S.spans("x" * 1_000_000, None, EMPTY)) == 1


def test_long_texts_are_classed_by_all_their_letters():
    """Places in step hold Latin letters or capitals only; the text as a whole doesn't."""
    assert S.language("aбвг" * 400, "en") == "ru" and S.language("aбвг" * 50_000, "en") == "ru"
    assert S._letter_case("Abc" * 1100) == "mixed" and S._letter_case("Abcdefghi" * 100 + "b" * 200_000) == "lower"


WORDS = "winter roads letters table under over captain lantern clock brother river keeps knows asked told small quiet".split()
NAMES = "Ulmer Besna Halvo Ferola Pimela Quist".split()


def corpus(n, seed):
    """Documents of known sentences with titles, numbered volumes and words that end in a period."""
    rng = random.Random(seed)
    docs = []
    for d in range(n):
        text, spans = "", []
        for _ in range(12):
            words = [rng.choice(WORDS) for _ in range(rng.randint(3, 8))]
            at = rng.randrange(1, len(words))
            kind = rng.random()
            if kind < 0.3:
                words[at:at] = [rng.choice(["Mrs.", "Prof."]), rng.choice(NAMES)]
            elif kind < 0.5:
                words[at:at] = ["vol.", str(rng.randint(2, 300))]
            end = rng.choice([".", ".", ".", "?", "!", "..."])
            if rng.random() < 0.1:
                words.append("inc")
            s = " ".join(words)
            s = s[0].upper() + s[1:] + end
            if text:
                text += rng.choice([" ", "\n", " "])
            spans.append((len(text), len(text) + len(s)))
            text += s
        docs.append((d, text, spans))
    return docs


def test_learned_from_a_corpus(spark):
    docs = corpus(150, 1)
    df = spark.createDataFrame([(d, t, "en", 1) for d, t, _ in docs], "doc_id bigint, text string, lang string, sent_start int")
    models = S.learn(df)
    m = models["en"]
    assert m.title == {"mrs", "prof"} and m.number == {"vol"} and "inc" not in m.title
    rows = S.sentences(df, models)
    assert rows.dtypes == [("doc_id", "bigint"), ("sent_start", "int"), ("sent_end", "int")]
    got = {(r.doc_id, r.sent_start, r.sent_end) for r in rows.collect()}
    want = {(d, a, b) for d, _, spans in docs for a, b in spans}
    assert len(got & want) / len(got | want) > 0.99


def test_starters_and_collocations(spark):
    """Where case doesn't tell, the word behind an abbreviation does: one that starts sentences, or one that goes with it."""
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        words = [rng.choice(WORDS) for _ in range(6)]
        kind = rng.random()
        if kind < 0.3:
            words.insert(0, "therefore")
        elif kind < 0.6:
            words[3:3] = ["halvo", "co.", "ltd"]
        end = "." if kind < 0.8 else " co?" if kind < 0.9 else " etc."
        texts.append(" ".join(words) + end)
    docs = [(i, " ".join(texts[i : i + 10]), "en") for i in range(0, 300, 10)]
    models = S.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert models["en"].starter == {"therefore"} and ("co", "ltd") in models["en"].joined and not any(b == "therefore" for _, b in models["en"].joined)
    assert cut("roads went over halvo co. ltd winter etc. therefore letters asked. quiet co. therefore river", "en", models) == [
        "roads went over halvo co. ltd winter etc.", "therefore letters asked.", "quiet co.", "therefore river",
    ]


def test_models_hold_all_words_that_pass(spark):
    """Also the rarest of very many abbreviations; a verb's share is that of all words after speech, rare ones too."""
    code = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = [(i, " ".join(f"the {code(w)}. and you" for w in range(i * 50, i * 50 + 50) for _ in range(5 if w == 77 else 6)), "en") for i in range(104)]
    docs += [(1000 + i, f'"the and," {x} you', "en") for i, x in enumerate(["nods"] * 5 + ["said"] * 20 + [code(w) for w in range(6000, 6300)])]
    m = S.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))["en"]
    assert len(m.title) == 5200 and code(77) in m.title and m.verb == {"said"}


def test_frames(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "One. Two.", "klingon")], "doc_id bigint, text string, lang string")
    assert {tuple(r) for r in S.sentences(df, S.learn(df)).collect()} == {(3, 0, 4), (3, 5, 9)}
    none = df.limit(0)
    assert S.sentences(none, S.learn(none)).count() == 0
