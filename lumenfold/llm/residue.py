"""Template residue, filler and error-page text, by character n-gram models.

Models are counts of character n-grams of fixed examples: filler words, Latin filler,
notices of servers and browsers, slot words, and mentions (sentences that only talk
about residue). Slots are also modelled in a second view of the text, in which a run
of letters is one letter and a run of digits one digit, so that a slot counts whatever
its name. Natural prose is counted over all documents, and mixed with a fixed
reference.

Each n-gram has a log-likelihood ratio of a model against prose; n-grams that a model
does not know weigh against it. Sliding windows whose mean ratio lies above a threshold
above zero localise residue, and rows come from these windows only:

* filler and notices count if their windows cover half of a sentence or line, or a
  long stretch without a break; a notice quoted within a longer sentence does not;
* slots count wherever a window of either view lies above the threshold, unless
  windows of the mention model lie in the same sentence, or the mention model of the
  second view (paths, settings, regular expressions) explains the characters better.

What the windows cover, as a share of the text, is the coverage to exclude by.

Prose must not learn from residue that many documents repeat. Sentences with windows
against the fixed reference alone are therefore left out of the counts; that first
decision does not depend on the corpus, so residue in any share of the rows stays
residue. Only the n-grams of the examples are counted, a fixed number whatever the
corpus.

Defined results: null and empty texts hold no residue; repeated texts are judged
alike; texts of any length are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n of the n-grams: Latin filler, words, and slots in the second view.
LATIN_ORDER, ORDER, SLOT_ORDER = 3, 4, 5
#: n-grams of a window: Latin filler, filler words and notices, slot words, mentions, and slots in the second view.
LATIN_WINDOW, WINDOW, SLOT_WORD_WINDOW, MENTION_WINDOW, SLOT_WINDOW = 60, 8, 4, 16, 4
#: Mean ratio above which such a window is residue, or a mention.
LATIN_LEAST, LEAST, SLOT_WORD_LEAST, MENTION_LEAST, SLOT_LEAST = 0.45, 1.2, 3.5, 1.0, 1.5
#: Sum of the ratios that the windows of filler or a notice, and of slot words, must reach.
EVIDENCE, SLOT_EVIDENCE = 20.0, 22.5
#: Share of a sentence that its windows must cover, or the length of a stretch that stands for itself.
SENTENCE_SHARE, STRETCH = 0.6, 48
#: Share of prose in every model, least share of an n-gram in prose, and share of the reference in prose.
MIXED_IN, FLOOR, REFERENCE = 0.2, 3e-6, 0.05
#: Characters of texts scored in one pass.
PIECE = 1 << 18

#: Fixed examples of filler words and of notes that content is to follow.
FILLER_EXAMPLES = (
    "this is placeholder text for the page. this is sample text. dummy text for the title. filler text. lorem ipsum dolor sit amet",
    "sample title text. replace this with your own words. replace this text. sample title. sample description text.",
    "your text goes here. your title here. your name here. put your story here. double-click to edit this text.",
    "add your description here. enter a title here. insert text here. type here. click to edit. write something here.",
    "text to be added. to be completed. description coming soon. content coming soon. text follows. lorem text.",
    "blindtext für diese seite. platzhaltertext, wird noch ersetzt. hier steht ein beispieltext. bitte ersetzen. fülltext.",
    "hier steht bald ihr text. platzhalter für die überschrift, bitte ersetzen sie diesen text vor der veröffentlichung.",
    "texte factice à remplacer. texte de remplissage avant publication. votre texte ici. texte d'exemple à modifier.",
    "texto de ejemplo, sustituir. texto de relleno antes de publicar. su texto aquí. texto simulado, reemplazar.",
    "asdf asdf asdf qwert qwert qwert qwerty blah blah blah bla bla bla foo foo bar baz foo xxx xxx test test test",
    "asdfgh asdfgh asdf blah bla qwert foo xxx blah test asdf foo bla asdfgh test qwert blah foo xxx asdf qwertz yxcv",
    "test blah foo asdf xxx bla test foo qwert bla xxx test asdfgh qwert xxx asdf bla foo asdfgh foo blah xxx bla asdf",
    "zxcv zxcvb hjkl jkl jkl dfgh sdfg xyz xyz abc abc test test one two test 9 9 9",
)
#: Fixed examples of Latin filler: passages in general use.
LATIN_EXAMPLES = (
    "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure",
    "dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non",
    "proident, sunt in culpa qui officia deserunt mollit anim id est laborum. sed ut perspiciatis unde omnis iste natus error sit",
    "voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi",
    "architecto beatae vitae dicta sunt explicabo. nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed",
    "quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. neque porro quisquam est, qui dolorem ipsum quia",
    "dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam",
    "aliquam quaerat voluptatem. praesent vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae;",
    "pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. vivamus elementum semper nisi,",
    "aenean vulputate eleifend tellus, maecenas tempus, tellus eget condimentum rhoncus, sem quam semper libero, sit amet",
    "adipiscing sem neque sed ipsum. nullam quis ante, etiam sit amet orci eget eros faucibus tincidunt. donec vitae sapien ut",
    "libero venenatis faucibus, cras dapibus, curabitur ullamcorper ultricies nisi, nam eget dui, etiam rhoncus, quisque rutrum,",
    "cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus. integer tincidunt, phasellus viverra",
    "nulla ut metus varius laoreet, aliquam lorem ante, dapibus in, viverra quis, feugiat a, tellus.",
)
#: Fixed examples of server error pages and of browser notices; digits stand as 9.
NOTICE_EXAMPLES = (
    "999 not found. error 999. page not found. the page you requested could not be found. 999 page missing. no such page.",
    "999 internal server error. 999 bad gateway. 999 service unavailable. 999 gateway time-out. 999 forbidden. http error 999.",
    "<html><head><title>999 not found</title></head><body><center><h9>999 bad gateway</h9></center><hr><center>nginx</center></body></html>",
    "the requested address /page/99 was not found on this server. the requested url was rejected. that page does not exist.",
    "this content is no longer available. the owner removed it or the link has run out. this page has been removed or has expired.",
    "the upstream did not answer in time. the upstream server timed out. the server took too long to respond. request timed out.",
    "access denied. you do not have permission to view this page. you are not authorized. please log in to continue.",
    "your session has expired. log in again. sign in again to continue. your login has timed out. please sign in again.",
    "too many requests. slow down and retry after 99 seconds. try again later. rate limit exceeded. please wait a moment and retry.",
    "could not connect to the database. query failed after 999 ms. database error. fatal error. an unexpected error has occurred.",
    "service temporarily unavailable. the site is down for maintenance and will be back in a few minutes. please try again later.",
    "oops! something went wrong. we can't seem to find the page you are looking for. something went wrong on our side. sorry about that.",
    "error 999\nerror: 999. error 999. something went wrong. an error occurred while processing your request. please reload the page or try again.",
    "please enable javascript to view this page. javascript is required. this page does not work without it. javascript is disabled.",
    "you need to turn on scripts in your browser to run this app. enable cookies and scripts to continue to the site.",
    "your browser is not supported. update it or switch on scripts. it seems scripting is switched off. allow scripts and reload.",
    "please turn on javascript and cookies in your browser settings and reload the page. scripts are blocked by your browser.",
    "checking your browser before you continue. before showing the page. this takes a few seconds. turn off your ad blocker. please wait.",
    "erreur 999 : la page demandée est introuvable ou a été déplacée. erreur interne du serveur. accès refusé. veuillez réessayer plus tard.",
    "veuillez activer javascript pour afficher cette page. votre navigateur n'est pas pris en charge. activez les cookies et les scripts.",
    "seite nicht gefunden. fehler 999. die angeforderte adresse gibt es hier nicht mehr. interner serverfehler. zugriff verweigert.",
    "bitte versuchen sie es später noch einmal. bitte aktivieren sie javascript, um die seite zu sehen. aktivieren sie cookies.",
    "diese seite braucht javascript. diese karte braucht skripte. ihr browser blockiert sie. ihr browser wird nicht unterstützt.",
    "página no encontrada. el enlace que ha seguido puede estar roto. error 999. error interno del servidor. acceso denegado.",
    "active javascript en su navegador para ver esta página. su navegador no es compatible. inténtelo de nuevo más tarde.",
)
#: Fixed examples of slots that are words.
SLOT_EXAMPLES = (
    "[insert x here] (insert x here) <insert x here> [insert_x_here] [insert x] <insert x>",
    "[x goes here] (x goes here) <x goes here> [x goes here], [x goes here].",
    "(x tbd) [x tbd] <x tbd> (x tbd), [x tbd], (x tbd). [x tbd]. (x tbd)! [x tbd]! (x tbd): [x tbd]: (tbd) [tbd] <tbd>\n(x tbd)\n[x tbd]\n",
    "[your x] (your x) <your_x> [your_x] <your_y> <your_z> [your y] [enter x] <enter x> [enter your x] <enter_x>",
    "[object object]",
    "undefined",
    " undefined ",
    " undefined, ",
    " undefined. ",
    "\nundefined\n",
)
#: Fixed forms of slots in the second view, in which a stands for letters and 9 for digits, and what may stand around them.
SLOT_FORMS = (
    "{{a}}", "{{ a }}", "{{a a}}", "{{a.a}}", "{{ a.a }}", "{{ a a }}", "${a}", "${a.a}", "${a a}", "<%= a %>", "<% a %>", "<%= a.a %>",
    "{% a %}", "{% a a %}", "[[a]]", "[[ a ]]", "[[a a]]", "<<a>>", "<<a a>>", "@@a@@", "__a__", "%a%", "%%a%%", "%%a a%%", "%a", "%(a)a", "{{#a a}}", "$a$", "#a#",
    "##a##", "{a}", "{a a}", "{a.a}", "{9}",
)
AROUND_LEFT = ("a ", "9 ", ", ", ": ", "/ ", ". ", "\n", "(", "- ", "> ")
AROUND_RIGHT = (" a", " 9", ".", ". ", ", ", "! ", "? ", ": ", " /", "\n", ")", " (", "'a", "; ")
#: Fixed examples of sentences that only talk about residue.
MENTION_EXAMPLES = (
    "the token stands for the name. in the template the token was filled in. the placeholder stands for a value. a token called",
    "the variable is replaced by the export. the pattern files them by year. the folder pattern sorts by month. the naming pattern is",
    "the syntax of the template. a template variable named. the template says that the placeholder is replaced with the name of",
    "the regular expression matches. the regex was set to. the format string reads. the command prints. set the option to. the value of",
    "he explained that the code means. she wrote that the expression in the template. use the tag in your template. the string reads",
    "the field is filled from the template. the token gets replaced when the page is rendered. variables such as are filled later",
    "set the root with export. run the command with. the setting is called. the default value of the setting is. in the config file",
)
#: Fixed examples of paths, settings, markup and regular expressions in the second view.
MENTION_SHAPES = (
    "{a}/{a}/{a}", "{a}_{a}.a", "{a}-{a}-{a}", "/{a}/{a}.a", "a/{a}/a", "=${a}", "=${a}/a", "${a}/a", "=$a/a", "/$a/", "a${a}", "$a/a",
    "%a/%a/%a", "%a-%a-%a", "%a:%a:%a", "9%a", "\\a{9}", "[a-a]{9}", "a{9,9}", "a{9}-", "){9}", "a{9}a", "a[[a]]a", "({a})", "a({a: a})",
    "a__a", "a__a__a", "__a__(", "a@@a", "#a #a", "a#a#a",
)
#: Fixed reference of ordinary prose.
PROSE_EXAMPLES = (
    "we walked along the river in the morning and had lunch near the old bridge. the weather was fine, so the children went for a swim.",
    "in the evening my sister called and asked when the train would arrive at the station. nobody knew, but we waited for an hour.",
    "the house at the end of the street has been empty for years. he said that they would not sell it, and that was the end of it.",
    "there are three things to keep in mind when you buy a camera: the weight, the light and the price. you can try it before you pay.",
    "please bring warm clothes and something to eat, because the hut will be closed. it takes about two hours from the village.",
    "she did not want to talk about it. after that, the group went back to the hotel and looked at the pictures of the second day.",
    "this is the first time that we have been able to see the whole valley from above. the view was worth the long way up to the top.",
    "an object stood in the corner of the room, a beautiful objective view. the rules were defined by the owner, and we insert the card here.",
    "a short note on the page before the last one says who wrote the book. your friends have read it and were not sure what to think.",
    "run the scan again after moving the files. the settings are kept in one folder, and each import adds a line to the log.",
    "the server was down on monday, and my browser lost the page. error messages came up, which is why the upload had to wait.",
    "wir sind am morgen am fluss entlang gegangen und haben in der nähe der alten brücke gegessen. das wetter war schön, und die kinder",
    "waren im wasser. am abend hat meine schwester angerufen und gefragt, wann der zug ankommt. bitte bringen sie warme kleidung mit,",
    "denn die hütte ist nicht geöffnet. diese seite der straße ist noch leer, und es wird nicht mehr gebaut. hier steht ein haus für ihre gäste.",
    "nous avons marché le long de la rivière et déjeuné près du vieux pont. il faisait beau, et les enfants sont allés se baigner.",
    "le soir, ma soeur a appelé pour demander à quelle heure arrive le train. veuillez apporter des vêtements chauds pour cette promenade,",
    "car la cabane est fermée. cette page du livre n'a pas été lue, et votre place est déjà prise. la vue est belle avant le coucher du soleil.",
    "caminamos por el río y comimos cerca del puente viejo. hacía buen tiempo, y los niños se bañaron. por la noche mi hermana llamó para",
    "preguntar a qué hora llega el tren. su casa está al final de la calle, y no se vende. traigan ropa de abrigo antes de salir para ver esta",
    "vista, que no es la última de la semana. la carta que ha llegado puede ser de un amigo de más lejos, y el camino de vuelta es largo.",
    "9999-99-99t99:99:99 info scanned 99 files in 9.9 s. 99:99:99,999 --> 99:99:99,999 (9.9 km) f/9.9, iso 999. <p>it was late.</p>",
)
#: The same in the second view.
PROSE_SHAPES = (
    "a a a, a a a. a a a (a a) a 9 a 9.9 a (9.9 a), a a: a a; a-a a's a? a! \"a a,\" a. 'a' - a / a / a 9\na: a\n9. a\n- a\n* a\n",
    "9-9-9 9:9:9,9 --> 9:9:9,9\na a a.\n9-9-9a9:9:9 a a 9 a: a_9.a a/9.9, a 9. <a>a a.</a> <a>a a</a> a: [9.9, -9.9]\na: [a, a]\n---\na: a\n# a\n## a\n",
)
#: Parts of one in which ratios are counted, so that sums are whole numbers and may wrap round.
UNIT = 1000
KINDS = ("filler", "notice", "slot")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BREAK = "\0"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with breaks between them, and where each text starts and ends.

    Lower case, every digit a 9, line breaks kept, other spacing made one blank; a break
    is as long as a window, so that none reaches from text to text.
    """
    gap = _BREAK * WINDOW
    plain = [text.casefold() for text in texts]
    codes = _codes(gap + gap.join(plain) + gap)
    lengths = np.fromiter(map(len, plain), "i8", len(plain))
    starts = np.cumsum(np.concatenate([[0], lengths[:-1] + WINDOW])) + WINDOW if len(plain) else np.zeros(0, "i8")
    codes = np.where((codes >= 0x30) & (codes <= 0x39), np.uint32(0x39), codes)
    codes[codes == 0x2019] = ord("'")
    blank = (codes == 0x20) | (codes == 0x09) | (codes == 0x0D) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x202F)
    codes[blank] = 0x20
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], place[starts], place[starts + lengths]


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each character."""
    if len(codes) < order:
        return np.zeros(0, "u8")
    wide = codes.astype("u8") + np.uint64(1)
    mixed = np.zeros(len(codes) - order + 1, "u8")
    for n in range(order):
        mixed = (mixed + wide[n : len(codes) - order + 1 + n]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _kinds_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each character is a letter, and a digit; an underscore between letters is one."""
    table = _letter_table()
    low = np.minimum(codes, len(table) - 1)
    letter, digit = table[low], codes == ord("9")
    bar = codes == ord("_")
    if bar.any():
        inner = np.zeros(len(codes), bool)
        inner[1:-1] = bar[1:-1] & letter[:-2] & letter[2:]
        letter = letter | inner
    return letter, digit


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(n).isalpha() for n in range(0xD800)), bool, 0xD800)


def second_view(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with runs of letters and of digits as one character, and where each character stood."""
    letter, digit = _kinds_of(codes)
    again = np.zeros(len(codes), bool)
    again[1:] = (letter[1:] & letter[:-1]) | (digit[1:] & digit[:-1])
    at = np.flatnonzero(~again)
    return np.where(letter, np.uint32(ord("a")), codes)[at], at


class View:
    """The n-grams of the examples of one view, and their counts in each model."""

    def __init__(self, order: int, models: dict[str, tuple[str, ...]]):
        self.order = order
        hashes = {name: np.concatenate([gram_hashes(_codes(e), order) for e in examples]) for name, examples in models.items()}
        self.known = np.unique(np.concatenate(list(hashes.values())))
        self.first, self.second = np.zeros(1 << 18, "i4"), np.zeros(1 << 18, "i4")
        numbers = np.arange(1, len(self.known) + 1, dtype="i4")
        self.first[self._slot(self.known, 46)] = numbers
        crowded = self.first[self._slot(self.known, 46)] != numbers
        self.second[self._slot(self.known[crowded], 20)] = numbers[crowded]
        self.checked = np.concatenate([self.known[:1] + np.uint64(1), self.known])
        self.share = {name: self._counts(h) / max(1, len(h)) for name, h in hashes.items()}

    def _counts(self, hashes: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids(hashes), minlength=self.size)[: self.size].astype("f8")

    @property
    def size(self) -> int:
        return len(self.known) + 1

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype("i8")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each n-gram; 0 is one that stands in no example."""
        out = self.first[self._slot(hashes, 46)]
        other = np.flatnonzero(out)
        wrong = other[self.checked[out[other]] != hashes[other]]
        again = self.second[self._slot(hashes[wrong], 20)]
        again[self.checked[again] != hashes[wrong]] = 0
        out[wrong] = again
        return out

    def prose(self, counted: np.ndarray | None) -> np.ndarray:
        """Share of each n-gram in prose: the reference, and what was counted."""
        share = self.share["prose"]
        if counted is not None and counted.sum() > 0:
            share = REFERENCE * share + (1 - REFERENCE) * counted / counted.sum()
        share = share + FLOOR
        share[0] = 1.0
        return share

    def ratio(self, model: str, prose: np.ndarray, beside: str | None = None) -> np.ndarray:
        """Log-likelihood ratio of each n-gram, in UNIT parts; ``beside`` is a model that may explain it better than prose."""
        own = (1 - MIXED_IN) * self.share[model] + MIXED_IN * prose
        other = prose if beside is None else np.maximum(prose, self.share[beside])
        out = np.log(own / other)
        out[0] = np.log(MIXED_IN)
        return np.round(out * UNIT).astype("i4")


def slot_examples() -> tuple[str, ...]:
    """Every form of a slot with what may stand on either side."""
    return tuple(left + form + right for form in SLOT_FORMS for left in AROUND_LEFT for right in AROUND_RIGHT)


@lru_cache(maxsize=1)
def views() -> tuple[View, View, View]:
    """Words, Latin filler, and the second view."""
    words = View(
        ORDER,
        {"filler": FILLER_EXAMPLES, "notice": NOTICE_EXAMPLES, "slot": SLOT_EXAMPLES, "mention": MENTION_EXAMPLES, "prose": PROSE_EXAMPLES},
    )
    latin = View(LATIN_ORDER, {"filler": LATIN_EXAMPLES, "prose": PROSE_EXAMPLES})
    shapes = View(SLOT_ORDER, {"slot": slot_examples(), "mention": MENTION_SHAPES, "prose": PROSE_SHAPES})
    return words, latin, shapes


def _covered(scores: np.ndarray, width: int, least: float) -> np.ndarray:
    """n-grams that lie in a window whose mean is above ``least``, from its first good n-gram to its last."""
    out = np.zeros(len(scores), bool)
    if len(scores) < width:
        return out
    sums = np.zeros(len(scores) + 1, "i4")
    np.cumsum(scores, dtype="i4", out=sums[1:])
    high = np.flatnonzero(sums[width:] - sums[:-width] > int(least * width * UNIT))
    if not len(high):
        return out
    edge = np.zeros(len(scores) + 1, "i4")
    np.add.at(edge, high, 1)
    np.add.at(edge, high + width, -1)
    inside = np.cumsum(edge[:-1]) > 0
    # A window reaches past what raised it; cut the weak ends of each stretch.
    good = scores > 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    hits = np.flatnonzero(good)
    first = np.searchsorted(hits, starts)
    last = np.searchsorted(hits, ends, "right") - 1
    for a, b in zip(hits[np.minimum(first, len(hits) - 1)], hits[np.maximum(last, 0)]):
        if b >= a:
            out[a : b + 1] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of every run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view("i1"), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Judge:
    """Scores texts against prose, either the fixed reference alone or counts of a corpus."""

    def __init__(self, counted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        words, latin, shapes = views()
        prose = [view.prose(None if counted is None else counted[n]) for n, view in enumerate((words, latin, shapes))]
        self.words = {kind: words.ratio(kind, prose[0]) for kind in KINDS}
        self.mention = words.ratio("mention", prose[0], "notice")
        self.latin = latin.ratio("filler", prose[1])
        self.shapes = shapes.ratio("slot", prose[2], "mention")

    def sentences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the sentence or line that each character belongs to, and of its part between tags."""
        mark = (codes == ord(".")) | (codes == ord("!")) | (codes == ord("?"))
        blank = (codes == ord(" ")) | (codes == ord("<"))
        ends = (codes == ord("\n")) | (codes == 0)
        ends[1:] |= mark[:-1] & blank[1:]
        tags = codes == ord("<")
        tags[1:] |= codes[:-1] == ord(">")
        return np.cumsum(ends), np.cumsum(ends | tags)

    def read(self, texts: list[str]) -> tuple[list, np.ndarray, tuple]:
        """(text, kind, start, end) of residue in order of start, lengths, and what the prose counts need: ids of each view, and those in sentences with residue."""
        words, latin, shapes = views()
        codes, starts, ends = folded(texts)
        sentence, passage = self.sentences(codes)
        count, passages = int(sentence[-1]) + 1, int(passage[-1]) + 1
        broken = codes == 0

        def score(ids: np.ndarray, table: np.ndarray, void: np.ndarray, at_break: int) -> np.ndarray:
            out = table[ids]
            out[void[: len(ids)]] = at_break
            return out

        lines = np.where(broken, np.uint32(ord("\n")), codes)
        ids = words.ids(gram_hashes(lines, ORDER))
        of_gram, in_passage = sentence[: len(ids)], passage[: len(ids)]
        real = ~broken[: len(ids)]
        length = np.bincount(in_passage[real], minlength=passages)
        found: list[tuple[str, int, int]] = []
        scores = {kind: score(ids, self.words[kind], broken, 0) for kind in KINDS}
        either = (_covered(scores["filler"], WINDOW, LEAST) | _covered(scores["notice"], WINDOW, LEAST)) & real
        share = np.bincount(in_passage[either], minlength=passages) / np.maximum(length, 1)
        for a, b in zip(*_runs(either)):
            filler, notice = (np.maximum(scores[kind][a:b], 0).sum() for kind in ("filler", "notice"))
            if max(filler, notice) < EVIDENCE * UNIT:
                continue
            if b - a + ORDER - 1 >= STRETCH or share[in_passage[a:b]].max() >= SENTENCE_SHARE:
                found.append(("notice" if notice > filler else "filler", int(a), int(b) + ORDER - 1))

        latin_ids = latin.ids(gram_hashes(codes, LATIN_ORDER))
        of_latin = score(latin_ids, self.latin, broken, -99 * UNIT)
        flowing = _covered(of_latin, LATIN_WINDOW, LATIN_LEAST)
        if flowing.any():
            flowing &= _covered(of_latin, 2 * WINDOW, LATIN_LEAST)
        for a, b in zip(*_runs(flowing)):
            found.append(("filler", int(a), int(b) + LATIN_ORDER - 1))

        flat, at = second_view(codes)
        shape_ids = shapes.ids(gram_hashes(np.where(flat == 0, np.uint32(ord("\n")), flat), SLOT_ORDER))
        slots = [
            (int(at[a]), int(at[min(b + SLOT_ORDER - 2, len(at) - 1)]) + 1)
            for a, b in zip(*_runs(_covered(score(shape_ids, self.shapes, flat == 0, 0), SLOT_WINDOW, SLOT_LEAST) & (flat != 0)[: len(shape_ids)]))
        ]
        for a, b in zip(*_runs(_covered(scores["slot"], SLOT_WORD_WINDOW, SLOT_WORD_LEAST) & real)):
            if np.maximum(scores["slot"][a:b], 0).sum() >= SLOT_EVIDENCE * UNIT:
                slots.append((int(a), int(b) + ORDER - 1))
        if slots:
            spoken = _covered(score(ids, self.mention, broken, 0), MENTION_WINDOW, MENTION_LEAST)
            talked = np.bincount(of_gram[spoken & real], minlength=count) >= ORDER
        suspects = {int(s) for a, b in slots for s in sentence[[a, max(a, b - 1)]]}
        for a, b in slots:
            if not talked[sentence[min((a + b) // 2, len(sentence) - 1)]]:
                found.append(("slot", a, b))

        out = []
        for kind, a, b in sorted(found, key=lambda hit: hit[1]):
            n = int(np.searchsorted(ends, a, "right"))
            low, high = max(int(starts[n]), a), min(int(ends[n]), b)
            if high > low:
                out.append((n, kind, low - int(starts[n]), high - int(starts[n])))
        weak = np.zeros(count, bool)
        weak[of_gram[share[in_passage] >= SENTENCE_SHARE / 2]] = True
        weak[list(suspects)] = True
        for _, a, b in found:
            weak[sentence[a:b]] = True
        return out, ends - starts, (ids, latin_ids, shape_ids, weak[of_gram] | ~real, weak[sentence[: len(latin_ids)]] | broken[: len(latin_ids)], (weak[sentence] | broken)[at][: len(shape_ids)])

    def judge(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the residue in one text, in places of the folded text."""
        return [(kind, a, b) for _, kind, a, b in self.read([text])[0]] if text else []


def _stretches(text: str) -> Iterator[str]:
    """The text, or its parts of at most PIECE characters, cut at ends of lines or sentences if there are any."""
    while len(text) > PIECE:
        cut = max(text.rfind("\n", 0, PIECE), text.rfind(". ", 0, PIECE)) + 1 or text.rfind(" ", 0, PIECE) + 1 or PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def _pieces(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in lots of about PIECE characters, each with its number; a text of many stretches stands once for each."""
    numbers, lot, size = [], [], 0
    for n, text in enumerate(texts):
        for part in _stretches(text or ""):
            numbers.append(n)
            lot.append(part)
            size += len(part)
            if size >= PIECE:
                yield numbers, lot
                numbers, lot, size = [], [], 0
    if lot:
        yield numbers, lot


def prose_counts(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the examples' n-grams in all documents, outside sentences with residue; of each view."""
    sizes = [view.size for view in views()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, total = Judge(), [np.zeros(size, "i8") for size in sizes]
        for batch in batches:
            for _, lot in _pieces(batch.column(0).to_pylist()):
                words, latin, shapes, *left_out = judge.read(lot)[2]
                for sums, ids, out in zip(total, (words, latin, shapes), left_out):
                    sums += np.bincount(ids[~out], minlength=len(sums))
        flat = np.concatenate(total)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["gram", "n"])

    parts = documents.select(text).where(F.col(text).isNotNull()).mapInArrow(count, "gram bigint, n bigint")
    flat = np.zeros(sum(sizes), "f8")
    for row in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        flat[row["gram"]] = row["n"]
    return tuple(np.split(flat, np.cumsum(sizes)[:-1]))


def find_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kinds, coverage of every document with residue.

    kinds: slot, filler or notice, sorted. coverage: share of the text that the
    windows of residue cover.
    """
    counted = documents.sparkSession.sparkContext.broadcast(prose_counts(documents, text))
    kind = documents.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(counted.value)
        for batch in batches:
            kinds, covered, length = {}, {}, {}
            for numbers, lot in _pieces(batch["text"].tolist()):
                hits, sizes, _ = judge.read(lot)
                for n, size in zip(numbers, sizes):
                    length[n] = length.get(n, 0) + int(size)
                upto: dict[int, int] = {}
                for part, kind, a, b in hits:
                    n = numbers[part]
                    kinds.setdefault(n, set()).add(kind)
                    covered[n] = covered.get(n, 0) + max(0, b - max(a, upto.get(part, 0)))
                    upto[part] = max(b, upto.get(part, 0))
            ids = batch["doc_id"].tolist()
            rows = [(ids[n], sorted(kinds[n]), covered[n] / length[n]) for n in kinds]
            yield pd.DataFrame(rows, columns=["doc_id", "kinds", "coverage"])

    chosen = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return chosen.mapInPandas(scan, f"doc_id {kind}, kinds array<string>, coverage double").distinct()


def exclude_residue(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_coverage: float = 0.0
) -> DataFrame:
    """The documents whose residue covers no more than ``least_coverage`` of the text."""
    found = find_residue(documents, doc_id, text).where(F.col("coverage") > least_coverage)
    return documents.join(found.select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")
