"""What is commonly known of persons' names: given names, endings of surnames, and titles, of many languages.

These are priors of the generators of ``personal.py``; what a corpus says of a word goes before them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Common given names.
GIVEN = frozenset("""
adam agnieszka ahmed alejandro alessandro alexander ali alice amir ana andrea andreas andrés andrew andrzej angela anna anne antonio barbara ben benoît bożena bruno
carlos carmen catherine charles chen christian christine claire clara claudia daniel david diana diego edmund elena elizabeth emily emma eric erik eva ewa
fatima fernando francesca francisco françois frank gabriel george giovanni giulia grażyna guillermo halina hannah hans heike helen hélène henry hiroshi hugh ibrahim igor ines ingrid isabel ivan
jacek jack jacob jacques jakub james jan javier jean jennifer jessica joanna johann john jorge josé joseph juan julia jürgen karl katarzyna kate kevin klaus krzysztof
lars laura lee leon linda lisa louis lucas lucía luis łukasz magdalena małgorzata manuel marcin marco marek margaret maria marie mario markus marta martin mary matthias maximilian mehmet
michael michał michel miguel mohammed monika natalia nicolas nicole nina nora nuria olga oliver omar pablo patricia patrick paul paweł pedro peter philippe pierre piotr priya
rafael rahul ramón rebecca richard robert roberto rosa samuel sandra sara sarah sebastian sergio simon sofia sophie stefan stephen susan tadeusz teresa thierry thomas tom tomasz uwe victor wei william wolfgang xavier yusuf zofia
""".split())
GIVEN_OTHER = frozenset("""
александр алексей анастасия андрей анна антон борис василий виктор владимир дмитрий екатерина елена иван игорь ирина людмила максим мария михаил наталья николай ольга павел пётр семён сергей татьяна юлия юрий
αλέξανδρος ανδρέας άννα βασίλης γιάννης γιώργος γεώργιος δημήτρης ελένη ιωάννης κατερίνα κωνσταντίνος κώστας μαρία νίκος νικόλαος παναγιώτης σοφία χρήστος
""".split())
# Endings of surnames.
SURNAME_ENDS = (
    "ski", "ska", "cki", "cka", "dzki", "dzka", "skiego", "skiej", "ckiego", "ckiej", "skim", "ską", "wicz", "icz", "czyk", "czak", "owicz", "ović", "ić", "ová", "escu", "eanu", "enko", "chuk", "czuk", "yuk",
    "ov", "ova", "ev", "eva", "off", "sen", "sson", "dóttir", "mann", "stein", "berg", "bauer", "meier", "maier", "schmidt", "son", "ford", "worth", "ington", "field", "ez", "ández", "ínez", "eira", "inho", "elli", "etti", "ini", "ucci", "oglu", "oğlu", "yan", "ian", "shvili", "dze", "opoulos", "opoulou", "idis", "akis", "ellis",
    "ов", "ова", "ев", "ева", "ёв", "ин", "ина", "ский", "ская", "ской", "ского", "енко", "чук", "ян", "ов", "швили", "όπουλος", "οπούλου", "ίδης", "άκης", "ίου",
)
_ENDS = re.compile(f"(?:{'|'.join(sorted(SURNAME_ENDS, key=len, reverse=True))})$")
# Titles and forms of address before names, in small letters and without their stops.
TITLES = frozenset("""
mr mrs ms miss mx dr prof rev sir dame madam herr herrn frau fräulein hr fr mme mlle monsieur madame me maître maitre sr sra srta señor señora señorita don doña dña dna d sig signor signora dott
pan pani pana panu panem panią państwo ob mec inż mgr hab adw radca г-н г-жа господин госпожа гражданин гражданка гражданина товарищ др проф κ κος κα κύριος κυρία δρ κυρία senhor senhora dna dhr mevr mw
""".split())
# Forms of address in scripts without capitals, and common given names in them.
HONORIFIC_BEFORE = ("श्री", "श्रीमती", "सुश्री", "السيد", "السيدة", "الأستاذ", "الأستاذة", "คุณ", "นาย", "นาง", "นางสาว")
GIVEN_CASELESS = frozenset("राहुल प्रिया अमित सुनीता राजेश अनिल संजय विजय सीता नेहा محمد أحمد علي فاطمة عمر خالد حسن حسين مريم يوسف إبراهيم สมชาย สมศรี สมหญิง ประยุทธ วิชัย มานี สุดา อนันต์".split())


def fold(word: str) -> str:
    """A word without accents, which names are spelt with and without."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ł", "l")


_KNOWN = frozenset(map(fold, GIVEN | GIVEN_OTHER))
_TAILS = tuple(sorted(("a", "u", "owi", "em", "om", "ie", "y", "i", "ę", "ą", "o", "s", "’s", "'s", "ą", "у", "а", "ю", "ой", "е", "ы", "и", "ем", "ом", "я", "η", "ου", "ο", "ς", "υ"), key=len, reverse=True))


@lru_cache(100_000)
def given(word: str) -> float:
    """1 for a common given name, 0.8 for a form of one, 0 for another word (in small letters)."""
    plain = fold(word)
    if plain in _KNOWN:
        return 1.0
    for t in _TAILS:
        if len(word) - len(t) >= 3 and word.endswith(t):
            base = fold(word[: -len(t)])
            if any(base + e in _KNOWN for e in ("", "a", "а", "я", "и", "ь", "ς", "ος", "ης")):
                return 0.8
    return 0.0


@lru_cache(100_000)
def prior(word: str) -> float | None:
    """How name-like a word is by common knowledge, -1..1; None where that says nothing."""
    if g := given(word):
        return 0.75 * g
    if len(word) > 4 and _ENDS.search(word):
        return 0.2
    return None
