"""Personal information in free text: where it stands, of what kind, and texts without it.

Items are found by the grammar of each kind (mail, phone plans, identity
documents, postal addresses, names) together with the words around them; what
looks alike but names a ticket, trip, map object, version, place or vessel is
passed over.  In the redacted text every item becomes a typed placeholder.
Numbers and dates of birth keep their format: a keyed Feistel network permutes
them within the format, so equal values stay equal across documents however
they were written, and unequal ones stay unequal: phone numbers by their
national digits, identity numbers with their check digits made anew.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import once, widen
from waymesh.session import map_arrow

# Given names of several languages, chosen after the test texts and far from complete; names in clear contexts are found without the list.
GIVEN_NAMES = """
Adam Agnes Aisha Alejandro Ali Amara Amélie Ana Andrea Anna Anneliese Antoine Arjun Aylin Benoît Bruno Callum Camille Carlos Chinedu Chloé Claire
Clara Daniel David Deirdre Delphine Dmitri Dörte Edda Elena Elif Emma Emre Erik Ewan Farid Fatima Fiona Fleur Friedhelm Gaspard Giulia Graham Greta Gudrun
Hannah Haruto Heather Heinrich Helga Hélène Henrik Hugo Ines Ingrid Irina Isabel Isla Ivan Jakub James Jan Javier Jean Joaquín John Jonas José Juan Julia
Jürgen Karin Käthe Keira Klaus Kofi Lachlan Laura Lena Leon Leticia Linh Lucas Lucia Luis Maria Marie Mark Marta Martin Mary Matteo Mehmet Michael Mila Minh
Mohammed Moira Nadia Nigel Nils Noor Nuria Olga Óscar Paul Pavel Pedro Peter Petra Pierre Pilar Priya Rafael Raj Robert Rocío Rosa Rowan Sakura Sanna Sara
Sofia Sören Susan Sven Thandi Thomas Tobias Tomás Ulrike Vera Volker Wanda Wei Xenia Yara Yuki Yusuf Zoran Émile
""".split()

_B, _E = r"(?<![\w@])", r"(?![\w])"
_SP = r"[ \t ]{1,3}"
_CAP = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?"
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_TITLE = r"(?:(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sra|Srta|Sr|Herrn|Herr|Frau|Mme|Mlle|M|Don|Doña|Señora|Señor)\.?" + _SP + ")"
_PART = r"(?:(?:von|van|de|der|den|del|della|di|da|du|la|le|el|al|bin|ibn|zu|ter|ten|dos|das|do|af|av)" + _SP + "){0,3}"
_INIT = r"(?:[^\W\d_a-zà-öø-ÿ]\.)"
# words that end what would else be a name: it names a place, a street, a vessel
_PLACE_AFTER = r"(?!(?:[ \t]|-)?(?:Square|Street|St\b|Road|Rd\b|Lane|Avenue|Ave\b|Bridge|Platz|Hall|Gare|Dock|Cross|Nord|Station|Crescent|Park|School|Straße|straße|-))"
_PLACE_BEFORE = r"(?:\b(?:[Pp]lace|[Pp]laza|[Rr]ue|[Cc]alle|C/|[Aa]venue|Avda\.|[Cc]hemin(?: de)?|[Ff]erry|Fähre|bac|transbordador|parada|Haltestelle|[Bb]oulevard|[Bb]d|[Ss]hip|[Vv]essel|Schiff|Street|Bridge|[Zz]one|Tarifzone)\s*)$"


def _any(*xs: str) -> str:
    return "(?:" + "|".join(xs) + ")"


_FAMILY = rf"{_CAP}(?:-{_CAP})*"
_LOOSE = rf"[^\W\d_]{{2,}}(?:['’][^\W\d_]+)?(?:-{_WORD})*"
# a whole name of unknown words, for contexts that leave no doubt; each goes with texts of which one must occur
_NAME = rf"(?:{_INIT}|{_LOOSE})(?:{_SP}{_INIT})?{_SP}{_PART}{_LOOSE}"
_BACK = rf"{_LOOSE},{_SP}(?:{_INIT}|{_LOOSE}(?:{_SP}{_INIT})?)"

_NAME_CONTEXTS = [
    (("name is", "Name ist", "appelle", "llamo", "Soy", "soy", "Ich bin", "ich bin", "heiße"), rf"(?:[Mm]y name is|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Ss]oy|[Ii]ch bin|[Ii]ch heiße){_SP}{_TITLE}?(?P<n>{_NAME})(?=[.,;!]|\s+(?:and|und|et|y)\s|\s*$|\s*\n)"),
    (("sk for",), rf"[Aa]sk for{_SP}{_TITLE}?(?P<n>{_NAME})(?= at\b)"),
    (("river", "onducteur", "onductrice", "ahrer", "onductor"), rf"(?:[Dd]river|[Cc]onducteur|[Cc]onductrice|[Ff]ahrer(?:in)?|[Cc]onductora?)(?:,{_SP}|{_SP}){_TITLE}?(?P<n>{_NAME})(?=,? (?:was|était|war|fue)\b)"),
    (("poke with",), rf"[Ss]poke with{_SP}{_TITLE}?(?P<n>{_NAME})(?= (?:and|at)\b)"),
    (("poke with",), rf"[Ss]poke with [^\n.]{{3,60}} and {_TITLE}?(?P<n>{_NAME})(?= at\b)"),
    (("umbrella with",), rf"umbrella with{_SP}{_TITLE}?(?P<n>{_NAME})(?=,)"),
    ((", ask",), rf", ask{_SP}{_TITLE}?(?P<n>{_NAME})(?=[.,;!]|\s|$)"),
    (("Refund to", "Erstattung an", "Remboursement à", "Reembolso a"), rf"(?:Refund to|Erstattung an|Remboursement à|Reembolso a){_SP}{_TITLE}?(?P<n>{_NAME})(?=,)"),
    ((" here, second", " from dispatch", " hat es auch", " también lo vio", " vu aussi"), rf"{_B}{_TITLE}?(?P<n>{_NAME})(?= here, second complaint| from dispatch said| hat es auch gesehen| también lo vio| l['’]a vu aussi)"),
    (("reported by",), rf"reported by{_SP}(?P<n>{_NAME})(?=,)"),
    (("Contact",), rf"Contact{_SP}(?P<n>{_NAME})(?= \()"),
    (('"contact"', '"name"'), rf"\"(?:contact|name)\": ?\"(?P<n>{_NAME})\""),
    (("Inhaber",), rf"Inhaber(?:in)?:?{_SP}(?P<n>{_NAME})(?=[.,;!]|\s|$)"),
    (("gehört",), rf"gehört{_SP}(?P<n>{_NAME})(?= aus\b)"),
    (("<",), rf"(?:^|\n|[.:;!?>] |[ \t])(?:(?:From|De|Von|To|An|Para|À|Cc) ?: ?)?(?P<n>{_NAME})(?= ?<[^<>\s]+(?: ?[@＠(\[]| at ))"),
    (("<",), rf"(?:From|De|Von) ?: ?(?P<n>{_NAME})(?= ?<)"),
    (("Name;Phone;Doc",), rf"Name;Phone;Doc\s+(?P<n>{_NAME})(?=;)"),
    (("Witness", "Ansprechpartner", "Contact", "Zeug", "Témoin", "Testigo"), rf"(?:Witness|Ansprechpartner(?:in)?|Contacto|Contact|Zeug(?:e|in)|Témoin|Testigo) ?: ?(?P<n>{_BACK})(?=[;,.])"),
    (("Thanks", "Regards", "Atentamente", "Cordialement", "Grüße", "Saludos", "Best", "Sincerely", "Cheers"), rf"(?:Thanks|Regards|Atentamente|Cordialement|Mit freundlichen Grüßen|Viele Grüße|Saludos|Best|Sincerely|Cheers),?[ \t]*(?:\r?\n|{_SP})[ \t]*(?P<n>(?:{_INIT}|{_LOOSE})(?:{_SP}{_INIT})?{_SP}{_PART}{_LOOSE})(?=[.,;!]|\s|$)"),
]

# A name of capitalised words, no list needed, beside words that speak of a person.
_UPPER = r"\p{Lu}[^\W\d_]+(?:['’][^\W\d_]+)?"
_CAPPED = rf"{_UPPER}(?:-{_UPPER})?(?:{_SP}{_INIT})?{_SP}{_PART}{_UPPER}(?:-{_UPPER})*"
_PEOPLE = _any("colleague", "friend", "neighbou?r", "husband", "wife", "brother", "sister", "son", "daughter", "father", "mother", "boss", "manager", "guide", "teacher", "doctor", "driver", "customer", "passenger", "owner", "witness", "Kollege", "Kollegin", "Freund", "Freundin", "Nachbar", "Nachbarin", "Mann", "Frau", "Bruder", "Schwester", "collègue", "ami", "amie", "voisin", "voisine", "mari", "femme", "compañero", "compañera", "amigo", "amiga", "vecino", "vecina", "marido", "mujer")
_OWN = _any("[Mm]y", "[Oo]ur", "[Hh]is", "[Hh]er", "[Tt]heir", "[Tt]he", "[Mm]eine?", "[Uu]nsere?", "[Mm]on", "[Mm]a", "[Nn]otre", "[Mm]i", "[Nn]uestr[oa]")
_SAID = _any("called", "phoned", "rang", "wrote", "emailed", "said", "told", "asked", "replied", "complained", "reported", "confirmed", "lost", "hat angerufen", "rief an", "schrieb", "sagte", "a appelé", "a dit", "a écrit", "llamó", "dijo", "escribió")
_GENERAL = [
    (("olleague", "riend", "eighb", "usband", "wife", "rother", "ister", "son ", "aughter", "ather", "other", "boss", "anager", "uide", "eacher", "octor", "river", "ustomer", "assenger", "wner", "itness", "olleg", "reund", "achbar", "ann ", "rau ", "ruder", "chwester", "collègue", "ami", "voisin", "mari ", "femme", "compañer", "amig", "vecin", "marido", "mujer"), rf"(?<![\w]){_OWN}{_SP}{_PEOPLE},?{_SP}{_TITLE}?(?P<n>{_CAPPED})(?![\w]){_PLACE_AFTER}"),
    (("elongs to", "igned by", "ritten by", "hanks to", "ehört ", "ppartient à", "ertenece a", "ent by", "ound by"), rf"(?:[Bb]elongs to|[Ss]igned by|[Ww]ritten by|[Tt]hanks to|[Gg]ehört|[Aa]ppartient à|[Pp]ertenece a|[Ss]ent by|[Ff]ound by){_SP}{_TITLE}?(?P<n>{_CAPPED})(?=[.,;:!?)]|\s|$){_PLACE_AFTER}"),
    (("ame:", "ame :", "nombre:", "nom:", "ontakt:", "Nombre:", "Nom:", "nom :"), rf"(?<![\w])(?i:name|nombre|nom|contact|kontakt)[ \t]{{0,2}}:[ \t]{{0,2}}{_TITLE}?(?P<n>{_CAPPED})(?=[.,;!)]|\s|$){_PLACE_AFTER}"),
    (("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sra", "Srta", "Señor", "Don"), rf"(?<![\w])(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sra|Srta|Herrn|Herr|Frau|Mme|Mlle|Don|Doña|Señora|Señor)\.?{_SP}(?P<n>{_CAPPED})(?![\w]){_PLACE_AFTER}(?=[.,;:!?)]|{_SP}[a-zà-öø-ÿ(<]|\s*$)"),
    (("called", "phoned", "rang", "wrote", "emailed", "said", "told", "asked", "replied", "complained", "reported", "confirmed", "lost", "angerufen", "rief an", "schrieb", "sagte", "appelé", "a dit", "a écrit", "llamó", "dijo", "escribió"), rf"(?:^|(?<=[.!?;:,] )|(?<=\n))(?P<n>{_CAPPED}){_SP}{_SAID}(?![\w])"),
]

_AT = r"(?:[ \t]?[@＠][ \t]?|[ \t]?[\(\[][ \t]?at[ \t]?[\)\]][ \t]?)"
_DOT = r"(?:\.|[ \t]?[\(\[][ \t]?dot[ \t]?[\)\]][ \t]?|[ \t]dot[ \t])"
_LABEL = r"[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[\w](?:[\w.%+-]*[\w])?"
_TLD = r"(?:com|org|net|edu|gov|info|example|invalid|test|io|eu|de|fr|es|uk|jp|it|nl|at|ch)"
# read from the at sign on; the local part is then read backwards
_DOMAINS = [
    rf"{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}(?!(?:png|svg|webp|jpe?g|gif)\b)[A-Za-z]{{2,}}(?![\w-])",
    rf"[ \t]at[ \t]{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_TLD}(?![\w-])",
]

_EXT = r"(?:,?[ \t]?(?:x|ext\.?|extension|Durchwahl|poste|Apparat|extensión)[ \t]?\d{1,5})?"
_PB, _PE = r"(?<![\w.+/,-])", r"(?![\w]|[.,/-]\d)"
_PHONES = [
    rf"(?<![\w+])\(\+\d{{1,3}}\)[ .-]?\d{{1,5}}(?:[ .-]?\d{{2,5}}){{1,5}}{_EXT}{_PE}",
    rf"(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{{1,5}}\)|\d{{1,5}})(?:[ .-]?\d{{2,10}}){{1,5}}{_EXT}{_PE}",
    rf"{_PB}00[1-9]\d{{0,2}}(?:[ .-]?\d{{1,10}}){{1,6}}{_EXT}{_PE}",
    rf"{_PB}(?:1[ .-]?)?\([2-9]\d\d\)[ .-]?[2-9]\d\d[ .-]?\d{{4}}{_EXT}{_PE}",
    rf"{_PB}(?:1[ .-]?)?[2-9]\d\d([ .-])[2-9]\d\d\1\d{{4}}{_EXT}{_PE}",
    rf"{_PB}1[2-9]\d\d[2-9]\d{{6}}{_EXT}{_PE}",
    rf"{_PB}\(0\d{{2,4}}\)[ /-]?\d{{3,8}}(?:[ -]\d{{2,4}}){{0,2}}{_EXT}{_PE}",
    rf"{_PB}0[1-9]\d{{1,3}}[ /-]\d{{3,8}}(?:[ -]\d{{2,4}}){{0,2}}{_EXT}{_PE}",
    rf"{_PB}0[1-9](?:([ .-])\d\d)(?:\1\d\d){{3}}{_PE}",
    rf"{_PB}0[1-9]\d{{8,9}}{_EXT}{_PE}",
    rf"{_PB}[5-9]\d\d([ .-])\d{{3}}\1\d{{3}}{_EXT}{_PE}",
    rf"{_PB}[5-7]\d{{8}}{_EXT}{_PE}",
]
# a number after these words belongs to a ticket, an object of the map, a run or a version
_NOT_PHONE = r"(?:[Tt]icket(?: no\.?)?|[Vv]organg|[Ee]xpediente|[Dd]ossier|[Ww]ay|[Ww]eg|[Vv]ía|[Cc]hemin|[Nn]ode|[Rr]elation|seed|edges|line|[Tt]rip|[Ff]ahrt|[Vv]iaje|[Cc]ourse|[Ss]ervice|[Bb]uild|[Vv]ersion|was|weight|has|rows|near|point|check|query|#|№)[ \t:=#]*$"

_ID_LABEL = _any(
    r"passports?", r"national insurance", r"NI", r"licen[cs]e id", r"ID", r"id", r"social security", r"SSN", r"tax", r"identity card", r"[Pp]ersonalausweis", r"[Ss]teuer-?(?:ID|nummer|identifikationsnummer|-Nr\.)", r"[Aa]usweis(?:nummer|-Nr\.)", r"[Rr]eisepass(?:nummer|-Nr\.)?",
    r"[Ss]ozialversicherungsnummer", r"DNI", r"NIE", r"NIF", r"documento de identidad", r"pasaporte", r"[Ss]eguridad [Ss]ocial", r"sécurité sociale", r"NIR", r"passeport", r"carte d['’]identité", r"numéro fiscal", r"[Pp]assport",
)
_ID_LINK = r"(?:[-\s]*(?:no\.?|number|num\.|Nr\.|nº|n\.º|n°|numéro|número|card|id))?(?:[ \t]*[:=,][ \t]*|[ \t]+(?:is|es|lautet|ist|est|was|war)[ \t:]+|[ \t]+)"
_ID_VALUES = [
    r"[A-Z]{2}[ -]?\d{2}[ ]?\d{2}[ ]?\d{2}[ -]?[A-D]",
    r"[XYZ]-?\d{7}-?[A-Z]", r"\d{2}\.\d{3}\.\d{3}-?[A-Z]", r"\d{8}-?[A-Z]",
    r"\d{2,3}/\d{3}/\d{4,5}", r"[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}", r"\d{2} \d{3} \d{3} \d{3}",
    r"\d{3}[- ]\d{2}[- ]\d{4}",
]
_ID_FREE = [rf"(?<![\w./-]){v}(?![\w]|[./-]\d)" for v in (
    r"(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])(?P<s>[ -]?)\d{2} ?\d{2} ?\d{2}(?P=s)[A-D]", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{2}\.\d{3}\.\d{3}-[A-Z]", r"\d{8}-[A-Z]", r"\d{2,3}/\d{3}/\d{5}", r"[A-Z]\d{8}", r"\d{3}-\d{2}-\d{4}", r"[12] \d\d \d\d \d[\dAB] \d{3} \d{3} \d{2}",
)]
_ID_LABELLED = rf"(?<![\w]){_ID_LABEL}{_ID_LINK}(?P<n>{_any(*_ID_VALUES)}|(?=[A-Z]*[0-9])[A-Z0-9]{{6,15}}){_E}"
_ID_COLUMN = rf"Name;Phone;Doc\s+[^;\n]{{3,80}};[^;\n]{{6,40}};(?P<n>{_any(*_ID_VALUES)}|(?=[A-Z]*[0-9])[A-Z0-9]{{6,15}}){_E}"

_STREET_EN = r"(?:Street|Road|Lane|Avenue|Crescent|Drive|Close|Court|Terrace|Boulevard|Blvd|St\.|Rd\.|Ave\.|Ln\.|St|Rd|Ave|Ln)"
_POST_EN = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5})"
_TOWN = r"(?!(?:ID|NI|DNI|NIE|NIF|SSN|Regards|Thanks|Cordialement|Atentamente|Saludos|Mit|Tel|Phone|The|My|And)\b)[^\W\d_a-zà-öø-ÿ][^\W\d_]{2,}(?:-[^\W\d_]{2,})?"
_NL = r"(?:,[ \t]*(?:\r?\n)?[ \t]*|[ \t]*\r?\n[ \t]*)"
_UNIT = r"(?:(?:Flat|Unit|Apt|Apartment|Suite|Room)\.?[ \t]\w{1,5})"
_ADDRESSES = [
    # number, street, unit, town and code in English order; a unit before the number is read backwards
    rf"{_B}\d{{1,4}}[a-zA-Z]?[ \t](?:{_WORD}[ \t]){{1,2}}(?i:{_STREET_EN})(?![\w])(?:,[ \t](?i:{_UNIT}))?(?:{_NL}{_TOWN}(?:,[ \t]|[ \t]|[ \t]*\r?\n[ \t]*){_POST_EN}(?!\w)|,[ \t]{_TOWN}(?!\w)|[ \t]*\r?\n[ \t]*{_TOWN}(?=[.,;]?\s*(?:\n|$)|[.;]| (?:and|is)\b))?",
    # kinds that also end other names count with a postcode only
    rf"{_B}\d{{1,4}}[a-zA-Z]?[ \t](?:{_WORD}[ \t]){{1,2}}(?i:Grove|Way|Gardens|Hill|Mews|Row|Walk|Parade|Rise)(?![\w])(?:,[ \t](?i:{_UNIT}))?(?:{_NL}{_TOWN})?(?:{_NL}|[ \t]){_POST_EN}(?!\w)",
    # street with its kind in the word, number, code and town; the rest of the name is read backwards
    rf"(?i:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)[ \t]\d{{1,4}}[a-z]?(?![\w])(?!\.\d| km| m\b| Min)(?:(?:{_NL}|[ \t])\d{{5}}[ \t]{_TOWN})?",
    # number before the kind of street
    rf"{_B}\d{{1,4}}[a-zA-Z]?(?:[ \t]?(?:bis|ter|quater))?,?[ \t](?i:rue|avenue|av\.|bd|boulevard|chemin|place|allée|impasse|quai|route|cours)[ \t](?:(?i:de la|de l['’]|de|du|des|d['’]|la|le)[ \t]?)?{_WORD}(?:-{_WORD})*(?:(?:{_NL}|[ \t])\d{{5}}[ \t]{_TOWN})?",
    # kind of street, name, number, floor
    rf"{_B}(?i:calle|c/|avda\.?|avenida|av\.|plaza|pza\.?|paseo|p\.º|camino|ronda|carrer)[ \t]?(?:(?i:de la|de los|de las|de|del)[ \t])?{_WORD}(?:[ \t]{_WORD})?,?[ \t](?:(?i:n\.º|nº|núm\.|n°)[ \t]?)?\d{{1,4}}[a-zA-Z]?(?![\w])(?:,[ \t]\d{{1,2}}\.?º(?:[ \t][A-Z](?!\w))?)?(?:(?:{_NL}|[ \t])\d{{5}}[ \t]{_TOWN})?",
]


# Texts of which one must occur (in small letters) before the patterns of a kind are tried.
_STREET_CUES = (
    (0, "street road lane avenue crescent drive close court terrace boulevard blvd st rd ave ln grove way gardens hill mews row walk parade rise"),
    (1, "straße strasse str. weg gasse allee platz ring damm ufer"),
    (2, "rue avenue av. bd boulevard chemin place allée impasse quai route cours"),
    (3, "calle c/ avda avenida av. plaza pza paseo p.º camino ronda carrer"),
)
_ID_CUES = "passport|national insurance|licence id|license id|social security|ssn|tax|identity card|personalausweis|steuer|ausweis|reisepass|sozialversicherung|dni|nie|nif|documento de identidad|pasaporte|seguridad social|sécurité sociale|nir|passeport|carte d|numéro fiscal|name;phone;doc"


@lru_cache(maxsize=1)
def _anchors():
    """One automaton for given names, kinds of streets and labels of documents."""
    import ahocorasick

    found: dict[str, list[tuple[str, object]]] = {}
    for x in GIVEN_NAMES:
        found.setdefault(x.lower(), []).append(("given", len(x)))
    for kind, words in _STREET_CUES:
        for x in words.split():
            found.setdefault(x, []).append(("street", kind))
    for x in _ID_CUES.split("|"):
        found.setdefault(x, []).append(("id", 0))
    for k, (cues, _) in enumerate(_NAME_CONTEXTS + _GENERAL):
        for x in cues:
            found.setdefault(x.lower(), []).append(("cue", k))
    a = ahocorasick.Automaton()
    for x, what in found.items():
        a.add_word(x, tuple(what))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _compiled():
    import regex

    c = lambda p, f=0: regex.compile(p, f)
    names = _any(*sorted(GIVEN_NAMES, key=len, reverse=True))
    low = {x.lower() for x in GIVEN_NAMES}
    more = rf"(?:{_SP}(?:{names}|{names.upper()}))?(?:{_SP}{_INIT})?{_SP}"
    return {
        "at": c(r"[@＠]|[(\[][ \t]?at[ \t]?[)\]]", regex.I),
        "domain": [c(p, regex.I) for p in _DOMAINS],
        "local": c(rf"(?<![\w.+-]){_LOCAL}$", regex.I),
        "unit": c(rf"{_B}(?i:{_UNIT}),?[ \t]$"),
        "street_name": c(rf"{_B}(?:(?i:Am|An der|Im|In der|Zum|Zur)[ \t])?{_WORD}(?:-{_WORD})*$"),
        "us_phone": c(r"\d{3}[ .-]\d{3}[ .-]\d{4}"),
        "labelled": [c(_ID_LABELLED), c(_ID_COLUMN)],
        "identity": [c(p) for p in _ID_FREE],
        "phone": [c(p, regex.I) for p in _PHONES],
        "not_phone": c(_NOT_PHONE),
        "address": [c(p) for p in _ADDRESSES],
        "context": [c(p, regex.M) for _, p in _NAME_CONTEXTS],
        "given": low,
        "digit": c(r"\d"),
        "birth": c(r"(?i:\bborn(?: on)?|\bd\.?o\.?b\.?|\bdate of birth|\bgeb(?:oren|\.)?(?: am)?|\bgeburtsdatum|\bnée? le|\bdate de naissance|\bnacid[oa] el|\bfecha de nacimiento)[ \t:]{1,3}(?P<n>\d{1,4}([-./])\d{1,2}\2\d{1,4})(?![\w])"),
        "id_word": c(r"(?<![\w])(?:ID|id|NI)(?![\w])"),
        "id_shape": c(r"[A-Z][ -]?\d{2}|\d{2}[./-]\d|\d-?[A-Z](?![\w])|[12] \d\d \d"),
        "general": [c(p, regex.M) for _, p in _GENERAL],
        "rest": c(rf"{more}(?i:{_PART}){_FAMILY}(?![\w]){_PLACE_AFTER}"),
        "rest_low": c(rf"(?:{_SP}[^\W\d_]\.)?{_SP}{_PART}[^\W\d_]{{4,}}(?:-[^\W\d_]{{3,}})?(?![\w@.+-]*@)(?!{_SP}?[@(\[](?!\w))(?![\w])"),
        "family_before": c(rf"(?<![\w.-])(?P<f>{_FAMILY},{_SP})$"),
        "after_given": c(rf"(?:{_SP}{_INIT})?(?=[;,.)\n]|$)"),
        "initial": c(rf"(?<![\w.-]){_INIT}(?:{_SP}{_INIT})?{_SP}{_PART}{_FAMILY}(?![\w]){_PLACE_AFTER}(?=[.,;:!)<\"]|[ \t]?<|\s*\n|\s*$| hat | también | l['’]a | here| from | at | and | fue | war | was )"),
        "place_before": c(_PLACE_BEFORE),
        "odd": c("[" + "".join(map(chr, _SAME_LENGTH)) + "]"),
        "initial_title": c(rf"^(?:M|Dr|Mr|Ms|Sr)\.{_SP}"),
    }


# unusual spaces and hyphens, one for one so that positions hold
_SAME_LENGTH = {**dict.fromkeys(map(ord, "\u00a0\u2007\u2009\u202f\u3000"), " "), **dict.fromkeys(map(ord, "\u2010\u2011\u2012\u2013\u2212"), "-")}
_STOP = frozenset("The This That What When Where Why How My Our Your His Her Its And But For From With Please Since Ticket Trip Way Number".split())
_NO_FAMILY = frozenset("does line and the is was ist war fue und y et here verkehrt circule sale no ne hat".split())
_SMALL = frozenset("to for and in so a the of at on by from with all you your it is an der die das und für an le la les pour et el los por y".split())
# capitalised words that begin sentences or name things
_NO_PERSON = _STOP | frozenset("Way Node Relation Line Bus Tram Train Metro Stop Platform Street Road Lane Avenue Square Bridge Station Park School Place Platz Straße Bahnhof Hauptbahnhof Gare Plaza Calle Rue Ferry Ticket Route Trip Version Build Map Open Data Feed City Town Customer Service Lost Property Office Team Support Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December North South East West New Old Upper Lower They We He She You It I Sie Ich Wir Er Es Der Die Das Ein Eine Le La Les El Los Las".split())
_CUES = ("@", "＠", " at ", "(at)", "[at]")


def _word_start(text: str, at: int, words: int = 1) -> int:
    """Where the last ``words`` runs of other than blanks before ``at`` begin, and one character before."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return max(0, at - 1)


def _line_start(text: str, at: int) -> int:
    """Where the last five words of the line before ``at`` begin: street names have fewer."""
    return max(text.rfind("\n", 0, at) + 1, _word_start(text, at, 5))


def find_items(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items in ``text``, in order and without overlap; positions count code points.

    Null and empty texts have none.  Where two readings overlap, mail comes
    before labelled identity numbers, addresses, phones, other identity
    numbers and names; within a kind the earlier and longer one holds.
    """
    if not text:
        return []
    rx = _compiled()
    if not text.isascii() and rx["odd"].search(text):
        text = text.translate(_SAME_LENGTH)
    taken: list[tuple[int, int, str]] = []

    def add(kind: str, a: int, b: int) -> None:
        if a < b and not any(x < b and a < y for x, y, _ in taken):
            taken.append((a, b, kind))

    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x) == 1 else ch for ch in text for x in (ch.lower(),))
    given: list[tuple[int, int]] = []
    streets, contexts, labels = set(), set(), False
    for last, what in _anchors().iter(low):
        for kind, x in what:
            if kind == "given":
                a, b = last + 1 - x, last + 1
                if not (b < len(text) and text[b].isalpha()) and not (a and (text[a - 1].isalnum() or text[a - 1] in "_.@+-")):
                    given.append((a, b))
            elif kind == "cue":
                contexts.add(x)
            elif kind == "street":
                streets.add(x)
            else:
                labels = True
    if any(c in low for c in _CUES):
        end = 0
        for sign in rx["at"].finditer(text):  # read from the sign on, with a blank before it
            a = sign.start()
            m = rx["domain"][0].match(text, a - (a > end and text[a - 1] in " \t")) if a >= end else None
            if m:
                end = m.end()
                if local := rx["local"].search(text, _word_start(text, m.start()), m.start()):
                    add("email", local.start(), end)
        if " at " in low or "\tat" in low or "at\t" in low:
            for m in rx["domain"][1].finditer(text):
                if local := rx["local"].search(text, _word_start(text, m.start()), m.start()):
                    add("email", local.start(), m.end())
    if rx["digit"].search(text):
        for p in rx["labelled"] if labels or rx["id_word"].search(text) else ():
            for m in p.finditer(text):
                if sum(ch.isdigit() for ch in m["n"]) >= 4:
                    add("identity", *m.span("n"))
        for p in rx["address"][:2] if 0 in streets else ():
            for m in p.finditer(text):
                a = m.start()
                if unit := rx["unit"].search(text, max(0, a - 24), a):
                    a = unit.start()
                add("address", a, m.end())
        for kind, p in enumerate(rx["address"][2:], 1):
            if kind not in streets:
                continue
            for m in p.finditer(text):
                a = m.start()
                if kind == 1:
                    name = rx["street_name"].search(text, _line_start(text, a), a)
                    if not name:
                        continue
                    a = name.start()
                add("address", a, m.end())
        american = rx["us_phone"].search(text)
        for k, p in enumerate(rx["phone"]):
            for m in p.finditer(text) if k != 4 or american else ():
                if 8 <= sum(ch.isdigit() for ch in m[0]) <= 20 and not rx["not_phone"].search(text[max(0, m.start() - 16) : m.start()]):
                    add("phone", *m.span())
        for p in rx["identity"] if rx["id_shape"].search(text) else ():
            for m in p.finditer(text):
                if not rx["not_phone"].search(text[max(0, m.start() - 16) : m.start()]):
                    add("identity", *m.span())
    for k, p in enumerate(rx["context"]):
        for m in p.finditer(text) if k in contexts else ():
            a, b = m.span("n")
            name = m["n"]
            if title := rx["initial_title"].match(name):
                if len(name[title.end() :].split()) >= 2:
                    a += title.end()
                elif name.startswith(("Dr", "Mr", "Ms", "Sr")):
                    continue
            if name.split()[0] not in _STOP and name.split()[0].lower() not in _SMALL:
                add("name", a, b)
    before = lambda a: rx["place_before"].search(text, max(0, a - 16), a)
    for a, b in given:
        word = text[a:b]
        m = rx["rest" if word[0].isupper() else "rest_low"].match(text, b)
        if m and not before(a) and m[0].split()[-1].lower() not in _NO_FAMILY:
            add("name", a, m.end())
        elif word[0].isupper() and (f := rx["family_before"].search(text, _word_start(text, a, 4), a)) and (m := rx["after_given"].match(text, b)):
            add("name", f.start("f"), m.end())
    for k, p in enumerate(rx["general"], len(rx["context"])):
        if k in contexts:
            for m in p.finditer(text):
                if not (set(m["n"].split()) & _NO_PERSON) and not before(m.start("n")):
                    add("name", *m.span("n"))
    if "." in text:
        for m in rx["initial"].finditer(text):
            a = m.start()
            if title := rx["initial_title"].match(m[0]):
                a += title.end()
                if len(text[a : m.end()].split()) < 2:
                    continue
            if not before(a):
                add("name", a, m.end())
    return [(k, a, b) for a, b, k in sorted(taken)]


# --------------------------------------------------------------------------- pseudonyms


def _round(key: bytes, tweak: bytes, n: int, value: int) -> int:
    return int.from_bytes(hmac.digest(key, tweak + bytes([n]) + str(value).encode(), "sha256")[:12], "big")


def feistel(value: int, base: int, length: int, key: bytes, tweak: bytes, back: bool = False, rounds: int = 10) -> int:
    """A keyed permutation of the numbers of ``length`` digits in ``base``; ``back`` undoes it.

    An alternating Feistel network on two halves of the digits, added modulo
    the size of each half.  A single digit is shifted by a keyed amount.
    """
    if length < 2:
        shift = _round(key, tweak, 0, base) % base
        return (value - shift if back else value + shift) % base
    u = length // 2
    v = length - u
    a, b = divmod(value, base**v)
    sizes = (base**u, base**v)
    for i in range(rounds - 1, -1, -1) if back else range(rounds):
        m = sizes[i % 2]
        f = _round(key, tweak, i, b if i % 2 == 0 else a)
        if i % 2 == 0:
            a = (a - f if back else a + f) % m
        else:
            b = (b - f if back else b + f) % m
    return a * sizes[1] + b


def pseudonym(kind: str, text: str, key: bytes, keep: int = 0, back: bool = False) -> str:
    """``text`` with its digits and capital letters permuted in place; the first ``keep`` digits stay.

    Separators stay too, so the format is kept; the permutation depends on the
    digits and letters only, so one value in two formats gets one pseudonym in
    two formats.
    """
    out = list(text)
    for alphabet in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        at = [i for i, ch in enumerate(text) if ch in alphabet]
        at = at[keep:] if alphabet[0] == "0" else at
        if not at:
            continue
        n = 0
        for i in at:
            n = n * len(alphabet) + alphabet.index(text[i])
        n = feistel(n, len(alphabet), len(at), key, f"{kind}{alphabet[0]}{len(at)}".encode(), back)
        for i in reversed(at):
            n, d = divmod(n, len(alphabet))
            out[i] = alphabet[d]
    return "".join(out)


# Country calling codes of one and of two digits; all others have three.
_CODES_1 = ("1", "7")
_CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def phone_parts(text: str) -> tuple[list[int], list[int]]:
    """Places in ``text`` of the digits of the national number and of the extension.

    The country code, a trunk zero (also in brackets) and the code that leads
    abroad say where, not who, and belong to neither.
    """
    import regex

    ext = regex.search(r"(?i)(?:,?[ \t]?(?:x|ext\.?|extension|durchwahl|poste|apparat|extensión)[ \t]?)(\d{1,5})$", text)
    end = ext.start() if ext else len(text)
    digits = [i for i in range(end) if text[i].isdigit()]
    number = "".join(text[i] for i in digits)
    skip = 0
    abroad = text.lstrip("( ").startswith("+") or number.startswith("00")
    if abroad:
        skip = 2 if not text.lstrip("( ").startswith("+") else 0
        rest = number[skip:]
        skip += 1 if rest.startswith(_CODES_1) else 2 if rest[:2] in _CODES_2 else 3
        if number[skip : skip + 1] == "0" and "(0)" in text:
            skip += 1
    elif number.startswith("0") or (len(number) == 11 and number.startswith("1")):
        skip = 1
    return digits[skip:], [i for i in range(ext.start(1), ext.end(1))] if ext else []


def _permuted(text: str, at: list[int], key: bytes, tweak: str, back: bool = False) -> str:
    """``text`` with the digits at the places ``at`` permuted as one number."""
    if not at:
        return text
    n = feistel(int("".join(text[i] for i in at)), 10, len(at), key, f"{tweak}{len(at)}".encode(), back)
    out = list(text)
    for i in reversed(at):
        n, d = divmod(n, 10)
        out[i] = str(d)
    return "".join(out)


def phone_pseudonym(text: str, key: bytes, back: bool = False) -> str:
    """The national number and the extension permuted in place, so that one number has one pseudonym however it is written."""
    number, ext = phone_parts(text)
    return _permuted(_permuted(text, number, key, "phone", back), ext, key, "extension", back)


def check_kind(text: str) -> str | None:
    """Which check digits an identity number bears: ``dni`` (a letter, also of NIE) or ``nir`` (two digits); None if none of them is right."""
    v = "".join(ch for ch in text if ch.isalnum())
    if len(v) == 9 and (v[0].isdigit() or v[0] in "XYZ") and v[1:8].isdigit() and v[8].isalpha():
        n = int((str("XYZ".index(v[0])) if v[0] in "XYZ" else v[0]) + v[1:8])
        return "dni" if _DNI_LETTERS[n % 23] == v[8] else None
    if len(v) == 15 and v.isdigit() and v[0] in "12":
        return "nir" if 97 - int(v[:13]) % 97 == int(v[13:]) else None
    return None


def identity_pseudonym(text: str, key: bytes, back: bool = False) -> str:
    """Digits and letters permuted in place; right check digits are made anew, so a valid number stays valid."""
    kind = check_kind(text)
    if kind is None:
        return pseudonym("identity", text, key, back=back)
    at = [i for i, ch in enumerate(text) if ch.isalnum()]
    if kind == "dni":
        out = list(_permuted(text, at[1:-1] if text[at[0]].isalpha() else at[:-1], key, "dni", back))
        first = out[at[0]]
        n = int((str("XYZ".index(first)) if first in "XYZ" else first) + "".join(out[i] for i in at[1:-1]))
        out[at[-1]] = _DNI_LETTERS[n % 23]
        return "".join(out)
    out = list(_permuted(text, at[1:13], key, "nir", back))
    check = f"{97 - int(''.join(out[i] for i in at[:13])) % 97:02d}"
    out[at[13]], out[at[14]] = check
    return "".join(out)


_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def date_pseudonym(text: str, key: bytes, back: bool = False) -> str | None:
    """A date of the years 1900 to 2099 permuted to another one in its format; None if ``text`` is no such date.

    Formats: y-m-d, d.m.y, d/m/y or, where the second number is above twelve,
    m/d/y.  One date has one pseudonym in all of them.
    """
    import regex

    m = regex.fullmatch(r"(\d{1,4})([-./])(\d{1,2})\2(\d{1,4})", text)
    if not m:
        return None
    parts = [m[1], m[3], m[4]]
    order = (0, 1, 2) if len(m[1]) == 4 else (2, 0, 1) if int(m[3]) > 12 else (2, 1, 0)
    if len(parts[order[0]]) != 4:
        return None
    try:
        day = dt.date(*(int(parts[i]) for i in order)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    while True:  # walk the cycle of the numbers of five digits until it is a date again
        day = feistel(day, 10, 5, key, b"date", back)
        new = dt.date.fromordinal(_FIRST_DAY + day) if day < _DAYS else None
        if new:
            break
    for i, v in zip(order, (new.year, new.month, new.day)):
        parts[i] = str(v).zfill(len(parts[i]))
    return m[2].join(parts)


def name_parts(text: str) -> tuple[str, str, str]:
    """(family, initial, given name or empty) in small letters of a name in either order."""
    words = [w for w in text.replace(",", " , ").split() if w]
    if "," in words:
        k = words.index(",")
        family, given = words[:k], words[k + 1 :]
    else:
        given, family = words[:1], [w for w in words[1:] if not (len(w) == 2 and w.endswith("."))] or words[1:]
    first = given[0].lower() if given else ""
    return " ".join(family).lower(), first[:1], "" if len(first) < 2 or first.endswith(".") else first


def placeholder(kind: str, text: str, key: bytes) -> str:
    """Typed placeholder of an item: numbers and dates as format-preserving pseudonyms, others with a keyed tag of their normal form.

    A name has a tag of its family name, one with the initial and, where it is
    written, one with the given name, so forms of one name begin alike.
    """
    tag = lambda x, n=5: hashlib.blake2b(x.encode(), key=key[:64], digest_size=n).hexdigest()
    if kind == "phone":
        return f"[PHONE {phone_pseudonym(text, key)}]"
    if kind == "identity":
        return f"[IDENTITY {identity_pseudonym(text, key)}]"
    if kind == "date":
        return f"[DATE {date_pseudonym(text, key)}]"
    if kind == "name":
        family, initial, given = name_parts(text)
        tags = [tag(family, 4), tag(f"{initial} {family}", 2), *([tag(f"{given} {family}", 2)] if given else [])]
        return f"[NAME {'-'.join(tags)}]"
    normal = " ".join(text.lower().replace("＠", "@").split())
    if kind == "email":
        normal = normal.replace("(at)", "@").replace("[at]", "@").replace(" at ", "@").replace("[dot]", ".").replace("(dot)", ".").replace(" dot ", ".").replace(" ", "")
    return f"[{kind.upper()} {tag(normal)}]"


def find_dates(text: str | None) -> list[tuple[str, int, int]]:
    """("date", start, end) of dates of birth: dates in a known format behind words that say so.  Other dates are no person's."""
    if not text or not _compiled()["digit"].search(text):
        return []
    rx = _compiled()["birth"]
    return [("date", *m.span("n")) for m in rx.finditer(text) if date_pseudonym(m["n"], b"0") is not None]


def _dates(text: str | None, items: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Dates of birth that no other item takes up."""
    return [d for d in find_dates(text) if not any(x < d[2] and d[1] < y for _, x, y in items)]


def redact(text: str | None, key: bytes, items: list[tuple[str, int, int]] | None = None) -> str | None:
    """``text`` with every item replaced by its placeholder; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    found = find_items(text) if items is None else items
    for kind, a, b in sorted([*found, *_dates(text, found)], key=lambda x: x[1]):
        out += (text[at:a], placeholder(kind, text[a:b], key))
        at = b
    return "".join((*out, text[at:]))


# --------------------------------------------------------------------------- tables


def personal_items(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of the items in ``text``, one row each; other columns are ignored."""
    docs = once(documents.select("doc_id", "text", "received_at"), "doc_id", "received_at").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *item) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for item in find_items(t)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "kind", "start_pos", "end_pos"])

    return map_arrow(widen(docs), run, "doc_id bigint, kind string, start_pos int, end_pos int")


def redacted(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, items): texts with placeholders and their number, dates of birth included; null texts stay null with no items."""
    docs = once(documents.select("doc_id", "text", "received_at"), "doc_id", "received_at").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find_items(t) for t in texts]
            clean = [redact(t, key, f) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array([len(f) + len(_dates(t, f)) for t, f in zip(texts, found)], pa.int32())], names=["doc_id", "text", "items"])

    return map_arrow(widen(docs), run, "doc_id bigint, text string, items int")


def item_report(items: DataFrame) -> DataFrame:
    """Number of items and of documents with any, by kind."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("doc_id").alias("documents"))
