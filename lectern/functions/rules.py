"""Fixed values that results depend on: word lists, thresholds, tables. Users may pass their own rows instead."""

from __future__ import annotations

# Words with a stop that does not end a sentence.
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "vol.", "no.", "fig.", "cf."]

# Function words of four letters or more.
STOPWORDS = """
that this these those with from have been were will would shall them they
their there which what when where while into unto upon through about also
only very such than then your yours ours because every other some more
most being does doing made make again said says
""".split()

# Books and the words that name them; the second list takes an ordinal.
BOOKS = """
Genesis: genesis gen ge gn
Exodus: exodus exod exo ex
Leviticus: leviticus lev le lv
Numbers: numbers num nu nm
Deuteronomy: deuteronomy deut deu dt
Joshua: joshua josh jos
Judges: judges judg jdg
Ruth: ruth rth rut
Ezra: ezra ezr
Nehemiah: nehemiah neh
Esther: esther esth est
Job: job jb
Psalms: psalms psalm psa pss ps
Proverbs: proverbs prov pro prv
Ecclesiastes: ecclesiastes eccl ecc
Song of Solomon: song songs canticles
Isaiah: isaiah isa is
Jeremiah: jeremiah jer
Lamentations: lamentations lam
Ezekiel: ezekiel ezek eze
Daniel: daniel dan dn
Hosea: hosea hos
Joel: joel joe
Amos: amos am
Obadiah: obadiah obad oba
Jonah: jonah jon
Micah: micah mic
Nahum: nahum nah
Habakkuk: habakkuk hab
Zephaniah: zephaniah zeph
Haggai: haggai hag
Zechariah: zechariah zech zec
Malachi: malachi mal
Matthew: matthew matt mat mt
Mark: mark mrk mk
Luke: luke luk lk
John: john jhn joh jn
Acts: acts act
Romans: romans rom ro
Galatians: galatians gal
Ephesians: ephesians eph
Philippians: philippians phil
Colossians: colossians col
Titus: titus tit
Philemon: philemon phlm
Hebrews: hebrews heb
James: james jas jam
Jude: jude jud
Revelation: revelation rev
"""
NUMBERED_BOOKS = """
Samuel: samuel sam sa
Kings: kings kgs kin
Chronicles: chronicles chron chr
Corinthians: corinthians cor
Thessalonians: thessalonians thess thes
Timothy: timothy tim
Peter: peter pet pe
John: john jhn joh jn
"""
ORDINALS = {"first": 1, "1st": 1, "1": 1, "second": 2, "2nd": 2, "2": 2, "third": 3, "3rd": 3, "3": 3}

# Number words.
ZH_DIGITS = "零一二三四五六七八九"
HI_UNDER_100 = """
शून्य एक दो तीन चार पाँच छह सात आठ नौ
दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस
बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस
तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस
चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास
पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ
साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर
सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी
अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी
नब्बे इक्यानवे बानवे तिरानवे चौरानवे पंचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे
""".split()
HI_HUNDRED, HI_THOUSAND = "सौ", "हज़ार"

# Media file extensions, statuses.
MEDIA = "mp3 mp4 m4a wav flac ogg opus aac wma mkv mov avi webm".split()
STATUSES = ["pending", "in_progress", "done", "failed", "skipped"]

# Styles of reading, older names and feelings that are read as one of them, sounds that a model may make.
STYLES, DEFAULT_STYLE = ["neutral", "calm", "emphatic"], "neutral"
MERGED_STYLES = {"gentle": "calm", "solemn": "calm", "warm": "neutral", "bright": "emphatic", "urgent": "emphatic"}
STYLE_ALIASES = {
    "excited": "emphatic", "happy": "emphatic", "angry": "emphatic", "shouting": "emphatic", "sad": "calm", "serious": "calm",
    "quiet": "calm", "soft": "calm", "whisper": "calm", "slow": "calm", "normal": "neutral", "plain": "neutral",
}
SOUND_TAGS = ["laugh", "chuckle", "cough"]

# Thresholds.
READING_RATE, REPEATED = 2.5, 0.6
GAP_SECONDS, SLACK_SECONDS, REFILL_WORDS = 1.5, 1.0, 3
SLOW_SECONDS, SLOW_RATE = 6.0, 1.3
CLOSING_SECONDS = 1.5
RUN_WORDS, PARAGRAPH_WORDS = 40, 120
LOUD_SHARE, LOUD_LEVEL = 0.4, 0.3
ORDER_SLACK = 0.5
CHUNK_BUDGET, GAP_CHUNK, GAP_PARAGRAPH, TAIL_LIMIT = 300, 0.28, 0.7, 0.55
DENSE_EXTRA, ABJAD_EXTRA = 3, 0.54
CHRF_FLOOR, EXCERPT_WORDS, FAILURE_RUN = 20.0, 34, 3
LARGEST_NUMBER = 9999


def book_rows(text: str) -> list[tuple[str, str]]:
    """(token, book) rows of a table above."""
    return [(token, line.split(":")[0]) for line in text.strip().splitlines() for token in line.split(":")[1].split()]

# How a chapter or verse is said, and letters heard for others of the same sound (after / before them).
CHAPTER_OR_VERSE = "第[〇零一二三四五六七八九十百千]+[章篇节節]"
SAME_SOUND = ("张張片節", "章章篇节")
