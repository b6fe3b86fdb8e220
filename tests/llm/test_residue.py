import pytest

from glimmerframe.llm import residue

DIALOGUE = ["The ferry left before dawn.", "What about your kettle?", "Come back before the rain.", "Nobody polished the jolly piano twice."]
RESIDUE = ["{{ show.name }}", "<INSERT_user>", "{% block date %}", "[[scene-id]]", "TODO: speaker", "@@cue_body@@", "%episode_title%", "Lorem usnoen ar um endol", "asdf asdf asdf asdf", "404 Not Found\nnginx", "We're sorry: this caption track tirned out. (code 403)", "PLEASE TURN ON JS AND RELOAD THIS PAGE.", "Bitte aktivieren Sie JavaScript, um die\nUntertitel zu sehen.", "Veuillez activer JavaScript pour continuer.", "INSERT NAME HERE", "{name}", "$NAME$", "503 Service Unavailable", "Bitte schalten Sie JavaScript ein", "Diese Seite wurde nicht gefunden.", "ここにテキストを入力", "{{ }}", "{% for item in list of all cues %}", "[Your text here]", "Lorem us asno dolen", "yyyy yyyy yyyy", "uiop uiop", "mon tablier\nTODO: show name", "You liave exceeded your daily download lirnit. Try\n\n7\n00:00:05,000 --> 00:00:06,000\nagain tornorrow."]
SPEECH = ["The sign at the diner said page not found, so we left.", "He typed error 404 on the cake as a joke.", "Access denied? By whom, the goose?", "You can't enable a man who won't wake up.", "Insert the coin here, then pull the lever.", "She learned Java in Lisbon and hated every script.", "{\\an8}<i>Room 503 is unavailable until the plumber is gone.</i>", "<|endoftext|>", "[door creaks]", "Advertise your product here - contact the team today", "No. No, no, no.", "Eso es todo: nos vamos", "Eso es\ntodo: nos vamos", "Sobre todo: calma.", "[your phone ringing]", "[insert coin sound]", "Bla bla bla bla", "Lorem is my cousin", "Mmm mmm mmm.", "Wer? Wer?", "Your name is not here", "{Y:i}{12}{40}A line of text", "It costs $5 or $6.", "", None]


def cued(line):
    return None if line is None else line and f"1\n00:00:01,000 --> 00:00:02,000\n{DIALOGUE[0]}\n\n2\n00:00:03,000 --> 00:00:04,000\n{line}\n\n3\n00:00:08,000 --> 00:00:09,000\n{DIALOGUE[1]}\n"


@pytest.mark.parametrize("wrap", [cued, lambda x: x])
def test_residue_is_found_and_speech_is_not(spark, wrap):
    texts = [wrap(x) for x in RESIDUE + SPEECH] + DIALOGUE * 200 + ["This is my house."] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as term")
    got = sorted(r.doc_id for r in residue.find_residue(df).collect())
    assert got == list(range(len(RESIDUE)))


def test_repeats_empty_table_and_removal(spark):
    df = spark.createDataFrame([(1, "lorem ipsum"), (1, "lorem ipsum"), (2, "word " * 300_000 + "{{ date }}"), (None, "fine"), (3, "fine")], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.find_residue(df).collect()) == [1, 2]
    assert sorted(r.text for r in residue.without_residue(df).collect()) == ["fine", "fine"]
    assert residue.find_residue(df.limit(0)).collect() == []


def test_index_agrees_with_comparing_every_window():
    labelled = ["red green blue white black", "{{ * }}", "blue blue"]
    index = residue.Index(labelled, {}, 10, 0.75)
    texts = ["red green blue white black", "red green blue white", "a red x green blue white b", "green red black", "{{ a b }}", "{{ }}", "}} a {{", "blue blue", "blue x blue"]
    got = [index.matches([residue.term(t) for t in residue.TOKEN.findall(x)]) for x in texts]
    assert got == [True, True, True, False, True, True, False, True, False]
