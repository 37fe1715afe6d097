"""Abusive, hateful and sexual language in subtitle files.

Cues are taken apart and their lines joined to sentences; each sentence is brought to a
plain form (tags, broken encodings, look-alikes, spaced letters, letters written as signs,
stretched letters) and scored by a linear classifier over words, word pairs and character
sequences. A document's score in a category is that of its worst sentence.

The classifier is trained in numpy on labelled sentences: those below, which were written
without the tables, and sentences of reviewed documents (at most ``REVIEWED``, chosen by a
hash), whose part in the majority of the marks is learned. It is regularised by counterfactuals: in every sentence that names a group of
people the group is swapped for others, and differences between the scores are penalised,
so that naming a group is no reason for a score.

Null, empty and blank texts score 0. A category without any cue in a document scores low,
never null.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.arrow import map_rows, sample
from veilframe.llm.lookalikes import INVISIBLE
from veilframe.llm.personal import one_script

CATEGORIES = ("abuse", "hate", "sexual")
REVIEWED = 6_000  # reviewed documents the driver reads for training
LONGEST = 100_000  # characters; longer documents are not trained on
BITS = 17
THRESHOLD = 0.5
CARRIED, LIKELY = 0.006, 0.2  # share of the marked documents (two at least) that must hold a sentence's telling words for it to be learned as a case, or the score it must have had before
SETTLED = 0.03  # a sentence scored this close to its label teaches nothing in that pass
REMEMBERED = 80_000

# Groups of people by nationality, faith, origin, sex and the like; swapped for one another in counterfactuals.
GROUPS = {
    "en": "foreigners|immigrants|refugees|women|men|gays|lesbians|jews|muslims|christians|hindus|black people|white people|asians|arabs|turks|poles|italians|africans|mexicans|gypsies|disabled people|old people|atheists",
    "de": "ausländer|flüchtlinge|frauen|männer|schwule|juden|muslime|christen|schwarze|türken|polen|italiener|afrikaner|behinderte|alte leute",
    "fr": "étrangers|immigrés|réfugiés|femmes|hommes|homosexuels|juifs|musulmans|chrétiens|noirs|arabes|turcs|polonais|africains|handicapés",
    "es": "extranjeros|inmigrantes|refugiados|mujeres|hombres|homosexuales|judíos|musulmanes|cristianos|negros|árabes|turcos|polacos|africanos|gitanos",
}
# Insulting nouns and adjectives, by language.
INSULTS = {
    "en": "idiot|moron|imbecile|cretin|bastard|bitch|slut|whore|scumbag|asshole|prick|dickhead|cunt|twat|wanker|jackass|dumbass|shithead|motherfucker|retard|loser|fool|maggot|swine|fag|faggot|pig|rat|cow|coward|scum|filth|trash|creep|halfwit|dimwit|simpleton|nobody",
    "de": "idiot|vollidiot|arschloch|mistkerl|trottel|schlampe|hure|drecksau|wichser|hurensohn|missgeburt|dummkopf|schwein|drecksack|fotze|blödmann|versager|ratte|abschaum|penner|miststück",
    "fr": "connard|connasse|salope|pute|ordure|imbécile|crétin|enculé|abruti|bâtard|salaud|pétasse|débile|con|raclure|minable|porc|idiot|fumier|déchet",
    "es": "cabrón|puta|imbécil|idiota|bastardo|zorra|gilipollas|basura|desgraciado|subnormal|capullo|cerdo|estúpido|inútil|rata|escoria|mierda|cretino|perra",
}
HARSH = {
    "en": "dumb|ugly|nasty|worthless|disgusting|lousy|miserable|fat|brainless|useless|goddamn",
    "de": "dumm|blöd|hässlich|dreckig|wertlos|erbärmlich|widerlich|fett|elend|verdammt",
    "fr": "stupide|sale|pauvre|gros|dégueulasse|pitoyable|ignoble|petit|vieux|misérable",
    "es": "estúpido|sucio|gordo|feo|patético|inútil|pobre|repugnante",
}
# How insults are used; {} is the noun, <> the adjective.
ADDRESSES = {
    "en": "you {}|you <> {}|you are a {}|you're such a {}|you're nothing but a <> {}|shut it, {}|go away, you <> {}|my boss is a complete {}|that guy is a <> {}|fucking {}|listen here, {}|your brother is a {} too",
    "de": "du {}|du <>es {}|du bist ein {}|du bist so ein <>er {}|hau ab, {}|dieser kerl ist ein {}|blödes {}|was für ein {} du bist|deine schwester ist eine {}",
    "fr": "{}|<> {}|tu es un {}|tu n'es qu'une {}|dégage, {}|ce type est un {}|quelle {}|va-t'en, <> {}|ta soeur est une {}",
    "es": "{}|<> {}|eres un {}|vaya {} eres|vete, {}|ese tipo es un {}|qué {}|calla, <> {}|tu hermana es una {}",
}
# What is said of groups in hate; used with the groups above.
HATE = {
    "en": "{} are vermin|{} are subhuman|{} are animals, not people|{} are a disease|{} are a cancer on this country|{} are parasites living off us|{} are filthy|all {} are criminals|all {} should be shot|all {} should be killed|we should burn {} alive|gas {}|exterminate {}|kill all {}|get rid of {} once and for all|send {} to the camps|{} do not deserve to live|{} must be wiped out|i hate {}, they are inferior|{} are cockroaches|no {} in our town, they are scum|{} are dirty thieves by nature|{} are stupid by blood|death to {}|{} ought to be drowned|hang {}|the world would be better without {}|{} are rats|beat up {} wherever you see them|{} are garbage|their race is inferior|{} should be sterilized|{} ought to be put down like dogs",
    "de": "{} sind ungeziefer|{} sind untermenschen|{} sind keine menschen|{} sind tiere|{} sind parasiten|{} sind dreck|{} sind abschaum|alle {} sind verbrecher|man sollte {} erschießen|man sollte {} vergasen|man muss {} ausrotten|tod den {}|{} haben kein recht zu leben|{} gehören verbrannt|wir brauchen keine {}, das ist gesindel|{} sind ratten|hängt {} auf|{} sind eine seuche|{} sollte man ersäufen|diese rasse ist minderwertig|prügelt {} aus der stadt",
    "fr": "{} sont de la vermine|{} sont des animaux|{} ne sont pas des humains|{} sont des parasites|{} sont de la racaille|{} sont une maladie|tous les {} sont des criminels|il faut tuer tous les {}|il faut exterminer les {}|il faut brûler les {}|mort aux {}|les {} ne méritent pas de vivre|{} sont des rats|pendez les {}|{} sont sales|cette race est inférieure|il faudrait noyer les {}|qu'on fusille les {}",
    "es": "{} son alimañas|{} son animales|{} no son personas|{} son parásitos|{} son escoria|{} son una plaga|todos los {} son criminales|hay que matar a todos los {}|hay que exterminar a los {}|hay que quemar a los {}|muerte a los {}|los {} no merecen vivir|{} son ratas|colgad a los {}|{} son sucios|esa raza es inferior|habría que ahogar a los {}|que fusilen a los {}",
}
# Neutral sentences about groups.
NEUTRAL = {
    "en": "{} voted in the election|many {} work in this hospital|i met some {} on holiday|the film is about {}|{} opened a restaurant here|my neighbours are {}|{} have their own festival in may|a law about {} was passed|most {} i know like music|{} and other people came to dinner|he wrote a book on {}",
    "de": "{} haben gewählt|viele {} arbeiten in diesem krankenhaus|der film handelt von {}|{} haben ein restaurant eröffnet|meine nachbarn sind {}|es gibt ein gesetz über {}|{} feiern im mai ein fest|er schrieb ein buch über {}",
    "fr": "les {} ont voté|beaucoup de {} travaillent dans cet hôpital|le film parle des {}|des {} ont ouvert un restaurant|mes voisins sont {}|il a écrit un livre sur les {}|les {} fêtent le mois de mai",
    "es": "los {} votaron|muchos {} trabajan en este hospital|la película trata de los {}|unos {} abrieron un restaurante|mis vecinos son {}|escribió un libro sobre los {}|los {} celebran una fiesta en mayo",
}
# Labelled sentences, "category language: sentences".
LABELLED = """
abuse en: i'm going to kill you|i'm gonna beat you up|i will strangle you|i'll stab you|i'll shoot you dead|i will rip your head off|i'll knock your teeth out|i'll break your legs|i want you dead|you will bleed for this|drop dead|go kill yourself|kys|die|nobody would cry at your funeral|go to hell|fuck you|fuk u|fuck off|screw you|piss off, you make me sick|shut your mouth|shut up or i hit you|i hope you get cancer|i hope you die slowly|i will hunt you down and hurt you|we'll beat the crap out of you|you deserve a beating|nobody likes you, you disgust me|your face makes me want to puke|kiss my ass|eat shit|i will make you suffer|watch your back or you end up dead|i'll drown you|i'd love to punch you|you stink and you are stupid|i will cut your fingers off|next time i see you i will hurt you badly
abuse de: ich bringe dich um|ich mache dich fertig|ich schlage dich tot|ich steche dich ab|ich erwürge dich|ich breche dir die beine|ich reiße dir den kopf ab|halt die fresse|halt dein maul|verrecke|geh sterben|fick dich|leck mich am arsch|niemand mag dich, du bist widerlich|du wirst dafür bluten|ich hoffe, du stirbst|verpiss dich|ich hau dir eine rein|ich erschieße dich|du bist so dumm und hässlich
abuse fr: je vais te buter|je vais t'étrangler|je vais te poignarder|je vais te frapper|je vais te casser la gueule|je vais t'arracher la tête|ferme ta gueule|ta gueule|crève|va mourir|nique ta mère|va te faire enculer|personne ne t'aime, tu es répugnant|tu vas saigner|j'espère que tu vas mourir|je vais te faire souffrir|je t'abattrai|tu es bête et laid
abuse es: voy a matarte|te voy a estrangular|te voy a apuñalar|te voy a pegar|te voy a partir la cara|te voy a arrancar la cabeza|cierra la boca|cállate la puta boca|muérete|ojalá te mueras|vete al infierno|que te den por culo|jódete|nadie te quiere, das asco|vas a sangrar|te voy a hacer sufrir|te voy a disparar|eres tonto y feo
sexual en: i would love to fuck you right here|fuck me harder|i want you inside me|she moaned as he touched her|he touched her breasts and she moaned|suck my dick|suck it and swallow|lick my pussy|open your legs wide|take your clothes off and get on the bed|get naked for me|i want to see you naked|show me your tits|her naked body made him hard|i am so horny|i am so wet|his hand went up her thigh|she stroked his cock|he came in her mouth|they made love all night|we had sex in the car|they fucked on the floor|he kissed her nipples|his tongue between her legs|she begged him not to stop as he thrust into her|your ass looks so good, i want to grab it|i masturbate thinking of you|ride me, baby|i dream of your naked skin on mine|her lips on his penis|he undressed her and caressed her body|i want to taste your skin all over
sexual de: ich will dich ficken|fick mich härter|ich will mit dir schlafen|sie stöhnte vor lust|er berührte ihre brüste|er streichelte ihre schenkel|zieh dich aus und leg dich aufs bett|zeig mir deine titten|ich will dich nackt sehen|ich bin so geil|ich bin so feucht|er leckte sie|blas mir einen|sie hatten sex im auto|ihre nackte haut machte ihn hart|sein schwanz war hart|spreiz deine beine
sexual fr: je veux te baiser|baise-moi plus fort|je veux coucher avec toi|elle gémissait de plaisir|il caressait ses seins|il caressait ses cuisses|déshabille-toi et viens au lit|montre-moi tes nichons|je veux te voir nue|je suis tellement excité|je mouille|il l'a léchée|suce-moi|ils ont fait l'amour dans la voiture|sa peau nue l'excitait|sa bite était dure|écarte les cuisses
sexual es: quiero follarte|fóllame más fuerte|quiero acostarme contigo|ella gemía de placer|él le acariciaba los pechos|él le acariciaba los muslos|desnúdate y ven a la cama|enséñame las tetas|quiero verte desnuda|estoy muy cachondo|estoy mojada|él la lamió|chúpamela|hicieron el amor en el coche|su piel desnuda lo excitaba|tenía la polla dura|abre las piernas
none en: i killed the engine|you're killing me with these jokes|he is dying to meet you|i'd kill for a coffee|knock them dead at the concert|the nurse examined her breasts|breast cancer is treated here|the doctor asked about my sex life|male and female birds have different colours|the mare was in heat|a stallion covered the mare|our dog is a bitch, not a male|the donkey was called an ass|the farmer fed the pigs and the cows|rats live in the sewer|the cat killed a mouse|cockroaches come out at night|kill the weeds with vinegar|the hunters shot two ducks|the naked truth hurts|he walked with naked feet|a naked flame is dangerous|the baby was naked in the tub|stupid computer|this damn printer|fucking traffic|shitty weather again|this bloody door is stuck|i am such a fool for forgetting|i was stupid to come by car|strip the paint from the wood|the film has no sex scenes|my thigh muscle aches|he kissed his mother on the cheek|come to bed, it is late|take off your shoes|good luck and break a leg|he beat me at chess|shoot me an email|i could eat a horse|see you in hell, said the pirate in the play|they hung the pictures on the wall|the plague killed many people in the past|hello|thank you|how are you today|we must leave at once|where is my coat|i think he went to the market|it is going to rain|she opened the window|nobody knows what happened|they came back in the evening|give me the key|no, not that one|what do you mean by that
none de: ich sterbe vor lachen|mach den motor aus|dieser verdammte drucker|blödes wetter|scheiß verkehr|der arzt tastete ihre brust ab|das schwein steht im stall|die ratten leben im keller|die katze hat eine maus getötet|das baby war nackt in der wanne|zieh die schuhe aus|komm ins bett, es ist spät|er hat mich im schach geschlagen|guten morgen|danke schön|wo ist mein mantel|wir müssen sofort gehen|ich glaube, er ist zum markt gegangen|es wird regnen|niemand weiß, was passiert ist|was meinst du damit|nein, nicht das|sie öffnete das fenster
none fr: je meurs de rire|coupe le moteur|cette fichue imprimante|sale temps|foutue circulation|le médecin palpe sa poitrine|le cochon est dans l'étable|les rats vivent à la cave|le chat a tué une souris|le bébé était nu dans le bain|enlève tes chaussures|viens te coucher, il est tard|il m'a battu aux échecs|bonjour|merci beaucoup|où est mon manteau|nous devons partir|je crois qu'il est allé au marché|il va pleuvoir|personne ne sait ce qui s'est passé|que veux-tu dire|non, pas celui-là|elle a ouvert la fenêtre
none es: me muero de risa|apaga el motor|esta maldita impresora|qué asco de tiempo|maldito tráfico|el médico le palpó el pecho|el cerdo está en el establo|las ratas viven en el sótano|el gato mató un ratón|el bebé estaba desnudo en la bañera|quítate los zapatos|ven a la cama, es tarde|me ganó al ajedrez|buenos días|muchas gracias|dónde está mi abrigo|tenemos que irnos|creo que fue al mercado|va a llover|nadie sabe qué pasó|qué quiere decir eso|no, ese no|ella abrió la ventana
"""

# ---- cues and sentences ----

_TIMES = re.compile(r"^[^\n]*-->[^\n]*$", re.M)
_TAG = re.compile(r"<[^<>\n]{0,40}>|\{\\[^{}\n]{0,20}\}")
_NUMBER = re.compile(r"^\s*\d*\s*$")
_TO_BYTE = {chr(b): b for b in range(0x80, 0x100)}
_TO_BYTE |= {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_BROKEN = re.compile("[ÃÂâ][" + "".join(map(re.escape, _TO_BYTE)) + "]")
_RUN = re.compile("[" + "".join(map(re.escape, _TO_BYTE)) + "]{2,}")
_STOPS = re.compile(r"(?<=[.!…♪])[\"'”’»]?\s+(?=\S)|(?<=\?)[\"'”’»]?\s+(?=[^\sa-zà-ÿ])|\n+")
_LINK = re.compile(r"://|www\.|\w\.[a-z]{3,8}(?:/|\b)| \. ?\w+$")
_OPEN = re.compile(r"[^.!?…♪:)\]*\"”»]$")


def mend(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, once or twice, read again."""
    def read(m):
        try:
            return bytes(_TO_BYTE[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    for _ in range(3):
        if not _BROKEN.search(text):
            break
        text = _RUN.sub(read, text)
    return text


def sentences(text: str) -> list[str]:
    """Sentences of a subtitle file; a sentence that goes on in the next cue is one."""
    if "<" in text or "{" in text:
        text = _TAG.sub("", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if _BROKEN.search(text):
        text = mend(text)
    parts: list[str] = []
    going = False
    for line in text.split("\n"):
        if not line or line.isspace() or line.isdigit() or "-->" in line or line.startswith("WEBVTT"):
            continue
        line = line.strip()
        if line.startswith("- "):
            line, going = line[2:], False
        if going:
            parts[-1] += " " + line
        else:
            parts.append(line)
        going = bool(_OPEN.search(line)) and not _LINK.search(line)
    return [s for p in parts for s in _STOPS.split(p) if s]


_GONE = dict.fromkeys(map(ord, INVISIBLE))
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]){2,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans("@$013457!|€", "asoieasti" + "le")
_SIGNED = re.compile(r"(?<![^\s.,;:\"()\[\]¡¿])[^\s.,;:\"()\[\]¡¿]*[@$0-9|€!][^\s.,;:\"()\[\]¡¿]*")
_STRETCH = re.compile(r"([^\W\d_])\1+")
_TOKEN = re.compile(r"[^\W_]+(?:\*+[^\W_]*)*|\*+[^\W_]+")


def _unsign(m) -> str:
    w = m.group().rstrip("!")
    if not any(c.isalpha() for c in w) and not ("@" in w or "$" in w):
        return m.group()
    if w.strip("0123456789") == "" or "://" in w:
        return m.group()
    return w.translate(_LEET)


def plain(sentence: str) -> str:
    s = sentence
    if not s.isascii():
        s = one_script(unicodedata.normalize("NFKC", s.translate(_GONE)))
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m.group()), s.lower())
    s = _SIGNED.sub(_unsign, s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s.replace("ß", "ss")) if not unicodedata.combining(c))
    return _STRETCH.sub(r"\1", s)


def tokens(text: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(text)]


# ---- the classifier ----


def _hash(x: str) -> int:
    h = 2166136261
    for b in x.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << BITS) - 1)


class Features:
    """Hashed features of plain sentences; hashes of words are remembered."""

    def __init__(self, masked: dict[tuple, list[str]] | None = None):
        self.masked = masked or {}
        self.of_word: dict[str, tuple] = {}
        self.pairs: dict[tuple, int] = {}

    def word(self, w: str) -> tuple:
        got = self.of_word.get(w)
        if got is None:
            if len(self.of_word) > REMEMBERED:
                self.of_word.clear()
            x = f"<{w}>"
            got = self.of_word[w] = (_hash("w" + w), *(_hash("c" + x[i : i + 4]) for i in range(max(1, len(x) - 3))))
        return got

    def unmask(self, words: list[str]) -> list[str]:
        """Starred words as the sensitive word they fit best; others stay."""
        out = []
        for w in words:
            if "*" in w:
                fit = [x for x in self.masked.get((len(w), w[0]), ()) if all(a in ("*", b) for a, b in zip(w, x))]
                out.append(_STRETCH.sub(r"\1", fit[0]) if fit else w)
            else:
                out.append(w)
        return out

    def __call__(self, text: str) -> np.ndarray:
        words = tokens(text)
        if "*" in text:
            words = self.unmask(words)
        out: set = set()
        for w in words:
            out.update(self.word(w))
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        for p in zip(["^", *words], [*words, "$"]):
            h = self.pairs.get(p)
            if h is None:
                h = self.pairs[p] = _hash(f"p{p[0]} {p[1]}")
            out.add(h)
        return np.fromiter(out, np.int64, len(out))


class Classifier:
    """One logistic score a category over the sum of feature weights, scaled by the root of their number."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, features: Features):
        self.w, self.b, self.f = weights, bias, features

    def scores(self, text: str) -> np.ndarray:
        x = self.f(text)
        if not len(x) or not any(c.isalpha() for c in text):
            return np.zeros(len(CATEGORIES), np.float32)
        return 1 / (1 + np.exp(-(self.w[x].sum(0) / len(x) ** 0.5 + self.b)))


Row = tuple[str, tuple, tuple]  # plain sentence, 0/1 a category, weight a category (0: not known)


def train(rows: list[Row], swaps: list[list[str]], features: Features, epochs: int = 12, penalty: float = 0.5, seed: int = 11) -> Classifier:
    """swaps: groups of sentences that differ only in the people they name; differences of their scores are penalised."""
    rng = np.random.default_rng(seed)
    n = len(CATEGORIES)
    w, b = np.zeros((1 << BITS, n), np.float32), np.full(n, -2.0, np.float32)
    g = np.full((1 << BITS, n), 1e-2, np.float32)
    gb = np.ones(n, np.float32)
    x = [features(t) for t, _, _ in rows]
    y = np.array([r[1] for r in rows], np.float32)
    weight = np.array([r[2] for r in rows], np.float32)
    pairs = [[features(t) for t in group] for group in swaps if len(group) > 1]
    rate = 0.5

    def push(f, d):
        g[f] += d * d
        w[f] -= rate * d / np.sqrt(g[f])

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f = x[i]
            if not len(f):
                continue
            k = len(f) ** -0.5
            p = 1 / (1 + np.exp(-(w[f].sum(0) * k + b)))
            d = (p - y[i]) * weight[i]
            if np.abs(d).max() < SETTLED:
                continue
            push(f, d * k + 1e-4 * w[f])
            gb += d * d
            b -= 0.3 * d / np.sqrt(gb)
        for i in rng.permutation(len(pairs)):
            one, two = rng.choice(len(pairs[i]), 2, replace=False)
            fa, fb = pairs[i][one], pairs[i][two]
            ka, kb = len(fa) ** -0.5, len(fb) ** -0.5
            d = penalty * np.clip(w[fa].sum(0) * ka - w[fb].sum(0) * kb, -3, 3)
            push(fa, d * ka)
            push(fb, -d * kb)
    return Classifier(w, b, features)


def written() -> list[tuple[str, str]]:
    """(category or none, sentence): the fixed sentences and patterns filled in turn."""
    out: list[tuple[str, str]] = []
    for line in LABELLED.strip().splitlines():
        head, body = line.split(": ", 1)
        out += [(head.split()[0], s) for s in body.split("|")]
    for lang, table in ADDRESSES.items():
        nouns, harsh = INSULTS[lang].split("|"), HARSH[lang].split("|")
        for k, pattern in enumerate(table.split("|")):
            for j, noun in enumerate(nouns):
                if (j + k) % 3 == 0 or k < 2:
                    out.append(("abuse", pattern.replace("<>", harsh[(j + k) % len(harsh)]).format(noun)))
    for lang, groups in GROUPS.items():
        for kind, table in (("hate", HATE), ("none", NEUTRAL)):
            for k, pattern in enumerate(table[lang].split("|")):
                out += [(kind, pattern.format(x)) for x in _some(groups.split("|"), 5 * k, 4)]
    return out


def _some(names: list[str], first: int, n: int) -> list[str]:
    return [names[(first + 3 * j) % len(names)] for j in range(n)]


def seeds() -> tuple[list[Row], list[list[str]], set[str]]:
    """Labelled sentences, groups of counterfactuals, and the words of the labelled positives."""
    rows, words, calm = [], set(), set()
    for kind, s in written():
        rows.append((plain(s), tuple(int(kind == c) for c in CATEGORIES), (1.0,) * len(CATEGORIES)))
        (calm if kind == "none" else words).update(_folded(s))
    swaps = [
        [plain(pattern.format(x)) for x in _some(groups.split("|"), k, 6)]
        for lang, groups in GROUPS.items()
        for table in (HATE, NEUTRAL)
        for k, pattern in enumerate(table[lang].split("|"))
    ]
    return rows, swaps, {w for w in words - calm if len(w) > 2}


def _folded(s: str) -> list[str]:
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return re.findall(r"[^\W\d_]+", s)


def _swaps_of(sentence: str, groups: list[list[str]]) -> list[str]:
    for names in groups:
        for x in names:
            if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", sentence):
                at = names.index(x)
                return [sentence] + [re.sub(rf"(?<!\w){re.escape(x)}(?!\w)", names[(at + k) % len(names)], sentence) for k in (3, 7, 11)]
    return []


def fit(documents: list[tuple[str, dict]], rounds: int = 3) -> Classifier:
    """documents: (text, {category: 1 or 0}) of reviewed documents.

    A mark is about a document, so which of its sentences earned it is learned in rounds: the model
    so far, and how much more often a sentence's words stand in documents with the mark than
    in those without, choose the sentence that carries a positive mark. Sentences of documents without
    the mark are negatives, the other sentences of a marked document are not used unless they stand
    mostly in documents without it. Wrong marks are outvoted: a chosen sentence that keeps
    turning up in documents without the mark stays a negative, and one that the model so far finds
    harmless counts only if its telling words stand in enough marked documents (``CARRIED``). The first round learns negatives only, so that
    the model knows common talk before it chooses.
    """
    rows, swaps, sensitive = seeds()
    model = train(rows, swaps, Features(_by_shape(sensitive)), epochs=8)
    parts: list[list[str]] = []
    surface: dict[str, str] = {}
    forms: dict[str, str] = {}
    for text, _ in documents:
        own = {}
        for s in sentences(text):
            if s not in forms:
                forms[s] = plain(s)
            own.setdefault(forms[s], s)
        surface |= own
        parts.append(list(own))
    n = len(CATEGORIES)
    counts = {p: np.zeros((n, 2)) for own in parts for p in own}
    for own, (_, marks) in zip(parts, documents):
        for p in own:
            for k, c in enumerate(CATEGORIES):
                if c in marks:
                    counts[p][k, marks[c]] += 1
    least = [max(2.0, CARRIED * sum(m.get(c, 0) for _, m in documents)) for c in CATEGORIES]
    lift, carried = _lift(parts, [m for _, m in documents])
    groups = [[plain(x) for x in g.split("|")] for g in GROUPS.values()]
    found_swaps = [near for p in counts if (near := _swaps_of(p, groups))]
    for turn in range(rounds + 1):
        score = {p: model.scores(p) for p in counts}
        chosen = {p: np.zeros(n) for p in counts}
        for own, (_, marks) in zip(parts, documents):
            for k, c in enumerate(CATEGORIES):
                if turn and own and marks.get(c):
                    best = max(own, key=lambda p: _logit(score[p][k]) + lift[p][k])
                    if _logit(score[best][k]) + lift[best][k] > -1.0:
                        chosen[best][k] += 1
        learned = []
        for p, c in counts.items():
            label, weight = [], []
            for k in range(n):
                neg, pos = c[k, 0], chosen[p][k]
                if pos and pos >= 0.6 * (pos + neg) and (carried[p][k] >= least[k] or score[p][k] >= LIKELY):
                    label.append(1), weight.append(1.0 + min(2.0, pos**0.5 / 2))
                elif pos:
                    label.append(0), weight.append(0.0)
                elif neg:
                    # a document without the mark can hold a case its reviewers missed
                    sure = neg >= 3 or score[p][k] < 0.7
                    label.append(0), weight.append((0.5 + min(1.5, neg**0.5 / 4)) * sure)
                else:
                    label.append(0), weight.append(0.3 * (score[p][k] < 0.3))
            learned.append((p, tuple(label), tuple(weight)))
            if any(label) and "*" not in surface[p]:
                sensitive |= {w for w in _folded(surface[p]) if len(w) > 3}
        calm = Counter(w for p, label, _ in learned if not any(label) for w in set(_folded(surface[p])))
        sensitive = {w for w in sensitive if calm[w] < 3}
        model = train(rows + learned, swaps + found_swaps, Features(_by_shape(sensitive)))
    return model


def _logit(p: float) -> float:
    p = min(max(float(p), 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _lift(parts: list[list[str]], marks: list[dict]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Per sentence and category: the log-odds of its four most telling words and pairs, by the documents that
    hold them, and in how many documents with the mark these stand (median)."""
    n = len(CATEGORIES)

    def terms(p):
        words = tokens(p)
        return set(words) | set(zip(words, words[1:]))

    of = {p: terms(p) for own in parts for p in own}
    counts: dict = defaultdict(lambda: np.zeros((n, 2)))
    total = np.ones((n, 2))
    for own, m in zip(parts, marks):
        held = set().union(*(of[p] for p in own)) if own else set()
        for k, c in enumerate(CATEGORIES):
            if c in m:
                total[k, m[c]] += 1
                for t in held:
                    counts[t][k, m[c]] += 1
    rate = total[:, 1] / total[:, 0]
    lift, carried = {}, {}
    for p, ts in of.items():
        known = np.array([counts[t] for t in ts if t in counts]).reshape(-1, n, 2)
        if not len(known):
            lift[p], carried[p] = np.zeros(n), np.zeros(n)
            continue
        odds = np.log((known[:, :, 1] + 0.7 * rate) / (known[:, :, 0] + 0.7) / rate)
        top = np.argsort(-odds, axis=0, kind="stable")[:4]
        lift[p] = np.take_along_axis(odds, top, 0).mean(0)
        carried[p] = np.median(np.take_along_axis(known[:, :, 1], top, 0), 0)
    return lift, carried


def _by_shape(words) -> dict[tuple, list[str]]:
    out: dict[tuple, list[str]] = defaultdict(list)
    for w in sorted(words):
        out[len(w), w[0]].append(w)
    return dict(out)


# ---- tables ----


def reviews(marks: DataFrame) -> DataFrame:
    """doc_id, category, mark: the majority of the reviewers, each with the last mark given; ties and nulls give no mark."""
    m = marks.where(F.col("mark").isin(0, 1) & F.col("category").isin(*CATEGORIES) & F.col("doc_id").isNotNull())
    last = m.groupBy("doc_id", "category", "reviewer").agg(F.max_by("mark", F.struct("marked_at", "mark")).alias("mark"))
    share = last.groupBy("doc_id", "category").agg(F.avg("mark").alias("share"))
    return share.where("share != 0.5").select("doc_id", "category", F.when(F.col("share") > 0.5, 1).otherwise(0).alias("mark"))


def fit_on(documents: DataFrame, marks: DataFrame) -> Classifier:
    """Trained on at most ``REVIEWED`` documents with a majority of marks, of up to ``LONGEST`` characters each."""
    marked = reviews(marks).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "mark"))).alias("marks"))
    given = {r["doc_id"]: r["marks"] for r in sample(marked, ["doc_id"], REVIEWED)}
    # so few keys that they are part of the filter: one scan, no join
    texts = documents.where(F.col("doc_id").isin(*given) & F.length("text").between(1, LONGEST)).select("doc_id", "text").collect() if given else []
    return fit([(r["text"], given[r["doc_id"]]) for r in sorted(texts, key=lambda r: r["doc_id"])])


def scores(df: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, abuse, hate, sexual: row-local; the weights (2**BITS x 3 floats) are broadcast."""
    used = np.flatnonzero(np.abs(classifier.w).sum(1) > 1e-6)
    sent = df.sparkSession.sparkContext.broadcast((used.astype(np.int32), classifier.w[used].astype(np.float32), classifier.b, classifier.f.masked))

    def make():
        rows, values, bias, masked = sent.value
        w = np.zeros((1 << BITS, len(CATEGORIES)), np.float32)
        w[rows] = values
        own = Classifier(w, bias, Features(masked))
        seen: dict[str, tuple] = {}
        zero = (0.0,) * len(CATEGORIES)

        def work(keys, texts):
            out: list[list] = [[], [], []]
            for t in texts:
                best = zero
                if t:
                    for s in sentences(t):
                        got = seen.get(s)
                        if got is None:
                            if len(seen) > REMEMBERED:
                                seen.clear()
                            got = seen[s] = tuple(own.scores(plain(s)).tolist())
                        if got[0] > best[0] or got[1] > best[1] or got[2] > best[2]:
                            best = tuple(map(max, best, got))
                for c, v in zip(out, best):
                    c.append(round(v, 4))
            return [keys, *out]

        return work

    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    return map_rows(df.select(key, text), make, f"{key} {kind.simpleString()}, abuse double, hate double, sexual double", [to_arrow_type(kind), pa.float64(), pa.float64(), pa.float64()])
