"""Abusive, hateful and sexual language, by a cascade of weighted finite-state transducers.

1. The spelling transducer (:mod:`spelling`) turns a clause into a lattice of
   readings: words as symbols of semantic fields (:mod:`abuse_words`), with costs.
2. Phrase transducers rewrite paths of the lattice as symbols of their own, each
   level reading what those before wrote: an insulting name (``SLUR``), a person
   (``WHO``), a group of people (``PEOPLE``), harm done to someone (``HURT``).
3. Clause transducers read fields and phrases: an insult with its target, a
   threat, a curse, a person driven out, a group demeaned, a sexual act or offer.
   A path through one is a hit; its weight less the costs is the score.
4. Context transducers read the lattice around a hit and take away from its
   score: negation, reported speech and words under discussion, self-mockery,
   and things, not persons, as what is spoken of. The hit is written into the
   lattice as ``HIT``; as ``AIMED`` if it addresses the reader, else ``TOLD``;
   as ``NAMED`` if it names a person or group, as ``OPEN`` if it may be meant for
   a thing, as ``INSULTS`` if for the speaker, as ``CITED`` in quotation marks.

All are machines in one notation, matched by one routine; the composition with
the lattice is made on the fly. In the notation, names in capitals stand for
symbols, other words for themselves in any spelling, ``a|b`` for a choice, ``?``
for an optional part, ``~n`` for up to n arbitrary words, ``^`` and ``$`` for the
beginning and end of a clause or a pause. Arbitrary words cost a little, a
negation among them (the polarity of the path turns), one that reports, or a
pause much more.
Isolated words score low; the score of a document is the greatest of its clauses.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.abuse_words import FIELDS, forms
from sigloom.llm.bpe import texts
from sigloom.llm.spelling import Lexicon, clauses, is_unspaced, letter_by_letter, pieces, plain, tokens_of, wrapped

#: Documents with at least this score count as abusive.
THRESHOLD = 0.5
#: Costs of an arbitrary word, and of one that negates, that speaks of the speaker, or after a pause.
GAP, NEGATED, SELF, PAUSE = 0.02, 0.7, 0.75, 0.12

#: Phrase transducers, in order: symbol, cost, what it reads.
PHRASES: list[tuple[str, float, str]] = [
    ("YOUARE", 0.0, "YOU BE|ARE"),
    ("YOUARE", 0.0, "ARE"),
    ("YOUARE", 0.0, "t es"),
    ("SLUR", 0.0, "PEJ|MILD? PEJ|MILD? INSULT PEJ?"),
    ("SLUR", 0.0, "PEJ PEJ|MILD? PEJ|MILD? BEAST|PERSONS"),
    ("SLUR", 0.05, "MILD PEJ|MILD? BEAST"),
    ("SLUR", 0.0, "BEAST|PERSONS PEJ"),
    ("SLUR", 0.0, "PEJ? HEAP OF PEJ|human? FILTH|BEAST|INSULT human|humana|umana?"),
    ("SLUR", 0.0, "FILTH humana|umana|humaine"),
    ("SLUR", 0.0, "PEJ? waste OF DET? LIFE|PERSONS"),
    ("SLUR", 0.0, "PEJ|MILD excuse|waste|lump|example OF ~2 PERSONS"),
    ("SLUR", 0.0, "PEJ waste|lump|bag|sack"),
    ("SLUR", 0.0, "son|daughter|child|fils|fille|figlio|figlia|hijo|hija|filho|filha OF DET? bitch|whore|pute|chienne|puttana|troia|puta|perra"),
    ("SLUR", 0.0, "PEJ|MILD little? FILTH"),
    ("SLUR", 0.0, "asco OF persona|tio|tia|gente"),
    ("SLUR", 0.0, "PEJ|INSULT|BEAST OF FILTH"),
    ("SLUR", 0.0, "ONE OF? SLUR"),
    ("WHO", 0.0, "THEY"),
    ("WHO", 0.0, "DET? ROLE"),
    ("WHO", 0.0, "YOUR MILD? ROLE|KIN"),
    ("PEOPLE", 0.0, "GROUP|SLURGROUP"),
    ("PEOPLE", 0.0, "KINDOF KINDOF? FOLK"),
    ("PEOPLE", 0.0, "DET ETHNONYM"),
    ("PEOPLE", 0.05, "UNKNOWN FOLK"),
    ("THEM", 0.0, "PEOPLE"),
    ("THEM", 0.0, "DET UNKNOWN|FOLK"),
    ("HURT", 0.0, "HARM DET? YOUR ~1 BODYPART|KIN|HOME"),
    ("HURT", 0.0, "HARM DET BODYPART"),
    ("HURT", 0.0, "YOUR? BODYPART HARM"),
    ("HURT", 0.05, "HARM YOU|YOUOBJ ~2 BODYPART"),
    ("HURT", 0.0, "HARM YOU|YOUOBJ"),
    ("HURT", 0.0, "YOUOBJ ~1 HARM"),
    ("HURT", 0.0, "YOUOBJ DET BODYPART HARM"),
]

#: Clause transducers: weight, what they read; ``<`` marks those that address the reader without a word for them.
CLAUSES: dict[str, list[tuple[float, str]]] = {
    "abusive": [
        # a person and an insulting name
        (1.0, "YOU|YOUARE ~3 SLUR"),
        (0.95, "YOUARE DET|ONLY|PEJ|MILD? DET|ONLY|PEJ|MILD? BEAST|FILTH"),
        (0.85, "YOU PEJ|MILD? BEAST"),
        (0.9, "WHO ~2 BE ~3 SLUR"),
        (0.75, "BE DET|WHAT? PEJ|MILD|DET? INSULT"),
        (0.9, "WHAT ~2 SLUR"),
        (0.9, "WHAT DET? BEAST|FILTH OF ~1 PERSONS"),
        (0.9, "espece OF ~1 INSULT|BEAST|SLUR"),
        (0.9, "HEY ~3 SLUR"),
        (0.9, "ONLY DET? ~1 SLUR would|could|writes|write|wrote|codes"),
        (0.85, "complete|total|utter|absolute ~1 SLUR"),
        (0.9, "never|jamais|nunca|nie|mai met|seen|rencontre|conocido|gesehen|visto ~3 SLUR"),
        (0.85, "SLUR and always will"),
        (0.85, "^ DET? PEJ|MILD PEJ|MILD? INSULT|BEAST $"),
        (0.6, "HARD"),
        (0.7, "PEJ PEJ? INSULT|BEAST"),
        (0.7, "SLUR OF DET? ROLE|PERSONS"),
        # said of a person
        (0.9, "YOUARE ~2 PEJ"),
        (0.8, "WHO BE ~1 PEJ ~1 and ~3 PEJ|INSULT|BEAST"),
        (0.9, "YOU|YOUARE too|zu|trop|demasiado|tan|so|troppo|doch ~2 PEJ|dense|thick"),
        (0.8, "YOUARE ~1 dense|thick|nothing|zero|mas ~1 $"),
        (0.85, "as|so|tan|mas|si PEJ|ugly as|like|wie|como|que|comme YOU|DET|YOUR|bread|brot|stroh"),
        (0.85, "as|so|tan PEJ ~1 as|wie|como YOU"),
        (0.85, "YOUARE ~1 PEJ|mas ~1 than|que|als|di|come ~2"),
        (0.85, "YOUR ~1 KIN ~4 PEJ|SLUR|SHAME|BORN|SCORN"),
        (0.85, "KIN should|hatte|aurait|deberia|avrebbe ~3 BORN|condom"),
        (0.9, "MIND LIKE|OF yours|YOUR|BEAST|DET ~1"),
        (0.85, "YOU have|has|hast|as|tienes|hai ~1 NONE ~1 MIND"),
        (0.85, "YOU have|has|hast|as|tienes|hai DET MIND OF"),
        (0.8, "YOUR MIND ~2 NONE|PEJ|FILTH|missing"),
        (0.8, "MIND OF DET BEAST|hamster|chicken|pea"),
        (0.8, "dropped on YOUR head|kopf|tete|cabeza|testa"),
        (0.9, "PEJ ~1 than|wie|que|como|di YOU|DET stone|rock|brick|piedra|sasso|caillou|brot|stroh"),
        (0.9, "dumbest|stupidest|dummste ~4"),
        # cast out
        (0.9, "NOBODY ~3 CARE ~1 YOU"),
        (0.9, "NOBODY YOU CARE"),
        (0.9, "NOBODY ~2 YOU CARE"),
        (0.85, "NOBODY would|will ~1 miss|cry|mourn|care|notice|weinen|vermissen|pleurer"),
        (0.7, "NOBODY asked|gefragt|sonne|demande|pregunto for? YOU|YOUR ~1"),
        (0.85, "EVERYBODY ~1 SCORN ~1 YOU"),
        (0.85, "we|i|team|ich|je|yo|io SCORN YOU"),
        (0.9, "world|team|project|we|everyone|welt|monde|mundo|mondo ~3 better|besser|mieux|mejor|meglio ~2 without|ohne|sans|sin|senza YOU"),
        (0.9, "YOU ~2 deserve|verdienst|merites|mereces|meriti ~2 WOE|DIE|beating|slap|pain|death|beaten|punched|schlage"),
        (0.9, "YOU ~1 NEG deserve ~1 EXIST|LIFE"),
        (0.85, "people|leute|gens|gente LIKE YOU ~3 NEG|never ~1 allowed|EXIST|BORN|let|near|trusted"),
        (0.85, "people|leute|gens|gente LIKE YOU ~3 should ~2 DIE|EXPEL|BORN"),
        (0.9, "YOU should|wish|hattest ~3 never ~2 BORN"),
        (0.9, "YOU NEG ~1 worth|vales|wert|vaux|vali nada|nothing|nichts|rien|niente|shit|mierda"),
        (0.9, "vales|vali nada|niente|mierda"),
        (0.9, "<stop|quit|hor|arrete EXIST ~4"),
        (0.9, "<DET? FAREWELL AWAY|YOU|HELL|YOURSELF ~2"),
        (0.85, "<FAREWELL ~2 OF|from|aus|del|du ~1 PLACE"),
        (0.85, "<fuck|fick|nique|screw|fanculo|jodete|fottiti|vaffanculo YOU|YOUR"),
        (0.9, "<vaffanculo|jodete|fottiti|chinga|foder|fodase|pierdol"),
        (0.85, "<go|geh|va|vete|vai|scher|idz|иди|пошел|пошла|пошли ~2 HELL|FILTH|culo|foutre|faire|хуй|хер|na|cu|foder"),
        (0.9, "<va|vas|va-t-en te? faire ~1 foutre|enculer|voir"),
        (0.9, "<CRAWL ~1 OUT|zuruck|retourne ~3"),
        (0.85, "<go|geh|crawl|retourne|vuelve|torna ~1 OUT|zuruck|a|in|alla|into ~3 LAIR|CHILDISH"),
        (0.85, "playing|play|spielen|jouer|jugar|giocare ~2 CHILDISH"),
        (0.85, "LAIR YOU came|crawled|kamst"),
        (0.85, "<SILENCE ~3"),
        (0.9, "<shut ~1 up YOU? ~2 SLUR|NOBODY"),
        (0.85, "<shut the fuck|hell up"),
        (0.9, "<BODYBAD ~3 MOUTH"),
        (0.9, "<YOUR MOUTH ferme|halt"),
        (0.85, "<ta|ferme gueule|la"),
        (0.8, "<get|raus ~1 OUT OF|aus ~3 SLUR"),
        (0.7, "<take|nimm YOUR ~1 FILTH"),
        (0.85, "<eat|friss|mange|come|mangia shit|scheisse|merde|mierda|merda"),
        (0.85, "<kiss|suck|lick|leck my ass|arse|balls|dick|cock|arsch"),
        (0.85, "<leck mich"),
        (0.85, "YOU|this DISGUSTS|SICKEN me|mich|mir"),
        (0.85, "YOU GIVES me|mir|mi ~1 SICKEN"),
        (0.85, "YOU|YOUR GIVES ~2 SICKEN ~1 LIKE? YOU?"),
        (0.85, "SICKEN|asco LIKE YOU"),
        (0.85, "fai|das|dai SICKEN"),
        (0.85, "YOU STINK"),
        (0.85, "STINK ~2 LIKE YOU"),
        (0.85, "^ apestas|puzzi|hueles"),
        (0.8, "YOU should|must|solltest|devrais|deberias|dovresti ~2 SHAME"),
        (0.8, "SHAME YOU ~2"),
        (0.85, "vergognati|averguenzate|schamdich|SHAME OF|to EXIST|leave"),
        (0.85, "MIND LIKE YOUR ~4 SHAME"),
        # death wished
        (0.95, "<SUICIDE ~1"),
        (0.95, "<ENDSELF SELFPRON|yourself ~1"),
        (0.9, "<go|geh|just|please|va|vas|vete|vai|ve ~1 DIE"),
        (0.9, "<go|geh|va|vas|vete|vai|ve ~1 te|YOU|a ENDSELF|pendre|tuer"),
        (0.9, "^ YOU|just|please|INSULT? drop dead"),
        (0.9, "^ DIE YOU? ~1 SLUR"),
        (0.85, "^ muerete|crepa|crevez|stirb|сдохни|сдохните|умри|umrzyj|zdechnij|去死|死ね|くたばれ|죽어|creve"),
        (0.85, "<JUMP ~3 HEIGHT"),
        (0.85, "<DRINK ~1 POISON"),
        (0.8, "<choke|rot|burn ~1 on|in ~1 own|hell|YOUR"),
        (0.9, "WISH ~1 YOU|YOUR ~4 WOE"),
        (0.9, "WISH ~2 WOE"),
        (0.85, "WISH|ojala|чтоб YOU ~1 WOE"),
        (0.85, "love|like|want|wish to see|watch YOU ~1 WOE|DIE|hang"),
        (0.85, "WISH ~3 get|bekommst|attrapes|atrapas cancer|krebs|aids"),
        # threats
        (0.9, "WILL ~3 HURT"),
        (0.8, "^ ~1 HURT"),
        (0.8, "SELF ~2 HURT"),
        (0.85, "HARM YOUR BODYPART ~1"),
        (0.8, "HARM YOU ~2 BODYPART|badly|hard|dead|slowly|up"),
        (0.85, "YOU|ti|te|je WILL? HARM ~2 BODYPART|WOE"),
        (0.9, "tear|rip|knock|reiss|schlag|arrache ~4 BODYPART out|off|ab|aus|ein|in"),
        (0.9, "BODYPART|zahne ein|aus|out"),
        (0.85, "SELF? HUNT YOU ~2 and ~2 HARM|HURT|faire|peau"),
        (0.85, "YOU HUNT ~2 AND YOU? ~3 peau|HARM"),
        (0.85, "faire|fare la peau|pelle"),
        (0.85, "KNOW WHERE ~1 YOUR ~1 KIN ~4 HAUNT|HOME"),
        (0.85, "KNOW WHERE HOME ~2 KIN|YOUR"),
        (0.85, "KNOW WHERE YOU|YOUR|HOME ~2 HOME"),
        (0.85, "SELF ~1 have|habe|ai|tengo|ho YOUR ~1 HOME ~3 $|WATCH|HUNT|coming|come|SEE"),
        (0.8, "come|coming|komme|viens|voy|vengo ~2 YOU ~2 tonight|kill|get|prendere|buscar"),
        (0.85, "coming for YOU"),
        (0.85, "YOU vengo|vado a prendere|cercare"),
        (0.85, "WILL|gonna make YOU ~1 CONSEQ|cry|beg|scream"),
        (0.85, "YOU|this WILL ~2 CONSEQ ~4 blood|life|alive|this|YOU|dear|blut|sang|sangre|sangue"),
        (0.85, "KEEP ~6 YOU WILL|are|BE ~3 LEAVE ~4 INJURY"),
        (0.85, "KEEP ~6 LEAVE ~4 INJURY"),
        (0.9, "not walk home|again|straight ~4"),
        (0.85, "YOU ~2 LEAVE ~2 in|im|dans|en|al|in INJURY"),
        (0.85, "put|shove|stick|jage|mettre|meter|piantare ~1 WEAPON INTO YOUR|YOU ~1"),
        (0.85, "put|jage ~1 bullet|kugel|balle|bala|pallottola ~4"),
        (0.9, "burn ~1 YOUR house|home|car"),
        (0.7, "watch YOUR back"),
        (0.85, "YOU BE ~1 dead meat|man"),
        (0.85, "YOUR days BE numbered"),
        (0.9, "mache|mach YOU ~1 fertig|kalt"),
        (0.85, "bringe|bring YOU um"),
        (0.9, "YOU|dich|te|ti WILL ~1 tuer|matar|uccidere|umbringen|fertig|zabic"),
        (0.9, "rape|raping YOU|YOUR ~1"),
        (0.85, "YOU gehorst|gehort ~2 EXPEL|verprugelt|geschlagen"),
        (0.8, "gehort|gehoren ~1 verprugelt|geschlagen"),
    ],
    "hateful": [
        (0.85, "SLURGROUP"),
        (0.9, "PEOPLE ~1 BE ~4 DEHUMAN"),
        (0.8, "PEOPLE LIKE|DEHUMAN DEHUMAN"),
        (0.85, "THEM BE ~3 DEHUMAN ~4 SHOULD|hay|faut ~3 EXPEL|OUT"),
        (0.9, "PEOPLE BE ~2 VICE|PEJ"),
        (0.85, "PEOPLE BE ~1 mentally ill"),
        (0.85, "PEOPLE have no|nichts place|business|verloren ~2"),
        (0.85, "MILD|PEJ race|rasse|raza|razza|brood"),
        (0.85, "PEOPLE BE? ~1 VICE and|or|und|et|y|e VICE"),
        (0.85, "THEM BE? ~2 VICE ~2 by? OF|par|por|per|von|by ESSENCE"),
        (0.85, "THEM ~2 STINK|VICE and|und|et|y|e VICE|STINK"),
        (0.85, "PEOPLE STINK"),
        (0.85, "THEM ~2 VICE ~4 OUT"),
        (0.85, "PEOPLE BREED ~2"),
        (0.85, "in|dans|en|nel their|ihrem|leur|leurs|su|loro ESSENCE to|zu ~1 VICE"),
        (0.85, "NEG real|true|echte human|humans|people|beings|menschen"),
        (0.9, "PEOPLE ~2 NEG ~1 human|humans|people|menschen|humains|humanos|umani"),
        (0.9, "PEOPLE ~6 SHOULD ~4 EXPEL|DIE|SILENCE|shut"),
        (0.85, "SHOULD be? ~1 EXPEL|thrown|kicked back|out|from ~2 border|country|land|society"),
        (0.85, "PEOPLE ~2 SHOULD be? put down|to sleep|away"),
        (0.85, "THEM BE ~3 PUT? EXPEL ~2 SHOULD|alle|all ~2"),
        (0.9, "STRONGEXPEL ~3 PEOPLE"),
        (0.85, "PUT ~4 PEOPLE ~1 OUT|BORDER|CONFINE"),
        (0.9, "PUT ~4 PEOPLE ~2 on|in|into|to|auf|ins ~1 BORDER|CONFINE"),
        (0.45, "PUT them|sie|les ~1 all|alle|tous? OUT"),
        (0.9, "PEOPLE ~6 PUT them|sie|les|us? ~1 OUT|away|camps"),
        (0.85, "PEOPLE OUT $"),
        (0.85, "PEOPLE OUT OF|aus ~2 BORDER|country|land"),
        (0.85, "OUT ~1 with|mit|con|avec PEOPLE|ihnen|them|eux|ellos|loro"),
        (0.85, "fuera|dehors|raus ~2 PEOPLE"),
        (0.85, "PEOPLE ~2 OUT ~2 BORDER|pais|pays"),
        (0.85, "PEOPLE a|in su|sus|casa|loro pais|tierra|casa|loro"),
        (0.9, "PEOPLE ~3 BELONG ~3 CONFINE"),
        (0.85, "CONFINE ~1 BELONG PEOPLE"),
        (0.85, "place for ~1 PEOPLE BE ~2 CONFINE"),
        (0.85, "PEOPLE BE behind ~1 CONFINE"),
        (0.85, "BELONG in|ins|en|dans camps"),
        (0.9, "PEOPLE ~2 CONFINE ~2 BELONG"),
        (0.85, "PEOPLE ~2 KNOW|knew their place"),
        (0.85, "PEOPLE ~2 NEG|no ~2 deserve|verdienen|meritent|merecen|meritano|have|sirven|saben|servono|konnen ~3"),
        (0.85, "PEOPLE ~2 NEG deserve ~3 RIGHTS"),
        (0.85, "PEOPLE haben ~3 nichts zu suchen"),
        (0.85, "PEOPLE ~2 SHOULD ~1 NEG|never ~2 near|allowed|trusted"),
        (0.85, "NEG PEOPLE ~1 allowed"),
        (0.85, "keep ~2 PEOPLE ~1 away|out"),
        (0.85, "NEG|nobody|never ~2 REJECT ~1 OF|a|by|to|with? ~1 PEOPLE"),
        (0.85, "never ~1 work|code|review|accept|hire|trust ~3 PEOPLE"),
        (0.85, "with|mit|con|avec PEOPLE ~2 REJECT ~2 NOBODY"),
        (0.85, "with|mit|con|avec DET UNKNOWN ~1 REJECT ~1 NOBODY"),
        (0.85, "NEG ~2 REJECT a|of|de PEOPLE ~2 here|ici|aqui|qui"),
        (0.9, "NEG ~2 REJECT ~1 OF|a ~1 THEM ~2 SLUR"),
        (0.85, "PEOPLE ~1 too|zu|trop|demasiado|troppo PEJ|VICE|MILD"),
        (0.85, "PEOPLE ~1 have|haben|ont|tienen|hanno ~2 MIND OF ~1 BEAST|DEHUMAN"),
        (0.85, "INFERIOR race|breed|people|rasse|race|raza|razza|folk"),
        (0.85, "MILD|PEJ|DEHUMAN PEOPLE"),
        (0.85, "PEOPLE OF|MILD? FILTH|mierda|merde|merda"),
        (0.85, "PEOPLE MILD|PEJ"),
        (0.85, "MILD|PEJ pack|gesindel|brood|chusma|racaille|parasites|DEHUMAN"),
        (0.85, "HATE ~1 all|alle|tous|todos|tutti? PEOPLE"),
        (0.85, "PEOPLE ~1 TAKE ~2 OURS"),
        (0.85, "PEOPLE ~8 TAKE ~2 OURS"),
        (0.85, "PEOPLE ~3 behind|hinter ~1 every|allem ~1"),
        (0.85, "PEOPLE ~5 FILTH|DEHUMAN follows|coming|comes|spreads|everywhere ~1"),
        (0.85, "PEOPLE BE ~1 why|reason|grund|raison|razon ~4 downhill|wrong|worse|ruined|broken|problem"),
        (0.85, "surname|nachname ~7 FILTH|DEHUMAN"),
        (0.85, "clean|clear|purge|sauber ~3 country|town|city|street|neighbourhood|neighborhood with|mit fire|feuer"),
        (0.85, "PEOPLE ~6 clean|clear|purge|wipe ~5 with fire"),
        (0.85, "clean ~2 DET country|neighbourhood|street OF PEOPLE"),
        (0.8, "first ~1 PEOPLE then ~1 rest"),
        (0.85, "should|must BE? wiped out|off"),
        (0.85, "PEOPLE ~3 wiped out|off"),
        (0.85, "get rid of ~2 PEOPLE"),
        (0.85, "PEOPLE ~3 back where|dorthin|la|d ~3 came|come|from"),
        (0.85, "FOLK|they BE ~1 subhuman|vermin|cockroaches|untermenschen"),
    ],
    "sexual": [
        (0.85, "EXPLICIT"),
        (0.9, "SEXV ~1 SELF|YOUR|her|his|him|mi|ton|mon|YOU ~1 SEXBODY|EROT|dry|hard|face"),
        (0.9, "SEXV ~2 SEXBODY"),
        (0.85, "SEXV me|mich|moi ~3 NIGHT|now|baby|please"),
        (0.85, "SEXV YOU ~3 NIGHT|INSIDE|dry"),
        (0.85, "WISH|want|wanna|will|quiero|voglio|envie|let ~3 SEXV|SEXBODY ~2 SELF|YOU|YOUR|SEXBODY|everywhere|partout"),
        (0.85, "want|wanna|will|quiero|voglio|envie|ganas ~1 OF? YOU? ~1 SEXV"),
        (0.8, "YOU|ti|te|dich ~4 ficken|bumsen|vogeln|follar|scopare|baiser"),
        (0.85, "follarte|scoparti|chuparte|chupamela|lamerte|leccarti|meterte|succhiarti|ficktdich ~2"),
        (0.85, "meterte|meterle|mettertelo|schieb|pushed|rammed|push|slid ~3 SEXBODY ~2"),
        (0.9, "SEXBODY ~3 AROUSED|INSIDE"),
        (0.85, "AROUSED ~2 SEXBODY"),
        (0.9, "YOUR|my|her|his|mine|deine|ta|tu|mi ~1 SEXBODY ~1"),
        (0.85, "SEE ~5 SEXBODY ~2"),
        (0.85, "SEE ~4 NAKEDPICS"),
        (0.85, "NAKEDPICS LURE|OF? ~2"),
        (0.85, "SEE ~3 PICS ~2 NAKED|SEXBODY"),
        (0.85, "PICS OF ~3 NAKED|SEXBODY|WOMEN NAKED?"),
        (0.85, "SEE|show ~3 EROT on|a|in PICS"),
        (0.85, "YOUR|her|his|deine|deinen|tes|ses|tus|sus|tuo ~2 NAKED EROT"),
        (0.85, "YOUR|her|his|tes|ses|tus|sus EROT NAKED"),
        (0.9, "KISS ~3 her|his|YOUR|le|les|los|las|ses|i ~1 EROT"),
        (0.85, "her|his|YOUR|ses|tes EROT ~2 KISS"),
        (0.85, "YOUR EROT ~3 AROUSED|good|hot|tight|fine|SEXY"),
        (0.85, "YOUR wet|naked|hot|sexy EROT"),
        (0.85, "lick|kiss ~1 every|DET ~1 EROT OF ~1 YOU|YOUR"),
        (0.85, "lick|kiss|lecher|lamer|leccare YOU ~1 everywhere|partout|overall|todo|tutta"),
        (0.85, "lecher partout"),
        (0.85, "te lecher|prendre ~2 sur|partout|bureau|lit"),
        (0.85, "UNDRESS ~1 YOU|her|him ~2 slowly|KISS|naked"),
        (0.8, "want|would|will|wanna ~2 UNDRESS YOU|her|him"),
        (0.85, "quitarte DET ropa|bragas"),
        (0.9, "PULLOFF ~1 her|his|YOUR|my|ihr|ihre|seine|sa|sus|le ~1 CLOTHES"),
        (0.9, "hand|hands|finger|fingers|hande|main|mano ~1 between|up|inside|zwischen|entre|tra her|his|YOUR|my|ihre|DET EROT|legs|CLOTHES"),
        (0.9, "spread ~1 her|his|YOUR|my legs|EROT"),
        (0.9, "MOAN ~3 PLEASURE"),
        (0.85, "WHO MOAN ~4 NAKED|KISS|INSIDE|when|wahrend|als|pendant|mientras|mentre"),
        (0.85, "MOAN ~2 NAKED"),
        (0.85, "UNTIL|until ~2 MOAN ~2"),
        (0.85, "SEXV ~3 until|till|bis ~2 MOAN"),
        (0.85, "from behind ~1 and|$"),
        (0.85, "take|took|nimm|prends|begged ~3 from behind"),
        (0.85, "every thrust"),
        (0.85, "WHO MOAN ~2"),
        (0.85, "HAVE SEX on|all|until|in|with|again|NIGHT"),
        (0.85, "naked|nackt|nue|desnuda ~1 and ~1 SEXV|MOAN"),
        (0.85, "ride|reiten YOU|me|him|her ~2 NIGHT"),
        (0.85, "sit on my face|lap|cock|dick"),
        (0.8, "touch|touching|finger|fingering myself ~2"),
        (0.85, "cum|came|come|cums all? over|in|inside|on her|his|my|YOUR|me ~1"),
        (0.85, "SEXY ~6 SEXV|NAKED|SEXBODY"),
        (0.85, "AROUSED ~2 for|auf|por YOU|dich|ti"),
        (0.85, "horny|geil|cachondo|cachonda|arrapato|arrapata"),
        (0.85, "SELF caliente|excitado|mojada|mouillee|feucht"),
        (0.85, "WILL ~1 SEXV her|him|YOU ~2 NIGHT|hard"),
        (0.85, "so hard|wet|geil|feucht for|when|auf|thinking ~1 YOU"),
        (0.85, "PORN ~1 PICS|LURE|clips|movies|site|stars|chat|toys|tape|tabus|WOMEN"),
        (0.85, "PICS ~2 NAKED|WOMEN NAKED"),
        (0.85, "WOMEN NAKED ~3 LURE|PICS|PORN"),
        (0.85, "NAKED WOMEN ~3 LURE|PICS|PORN"),
        (0.85, "NAKED PICS|body"),
        (0.85, "PICS|PORN ~2 NAKED WOMEN"),
        (0.85, "WOMEN ~2 UNDRESS ~3 LURE|YOU"),
        (0.85, "WOMEN AROUSED|LURE ~4 PORN|SEXV|YOU|PICS"),
        (0.85, "LURE PORN"),
        (0.85, "PORN LURE"),
        (0.85, "hardcore|uncensored ~2 SEX|PICS|movies|action"),
        (0.85, "SEX LURE|OF? ~2 LURE|tabus|limites|tabu|limiti"),
        (0.85, "anal|oral sex|included|inclus|incluido"),
        (0.85, "like|likes|love|loves it rough|anal ~2"),
        (0.85, "cock|penis ~2 pills|enlarge|bigger|minutes"),
    ],
}

#: Context transducers: what they take from the score of a hit, what they read around it.
CONTEXTS: list[tuple[float, str]] = [
    # negation
    (0.7, "NEG DET|BE|YOU|such? DET|PEJ? HIT"),
    (0.7, "NEG|NOBODY|hardly ~1 THINK ~3 HIT"),
    # words under discussion and reported speech
    (0.8, "META SUCH? SUCH? SUCH? SUCH? HIT"),
    (0.8, "CALLED ~4 HIT"),
    (0.7, "SAYS ~2 THAT ~2 HIT"),
    (0.7, "SAYS ~1 why|how|warum|pourquoi ~4 HIT"),
    (0.8, "HIT ~2 BE ~2 META"),
    (0.7, "HIT ~2 BE ~1 CALLED|MOD"),
    (0.7, "TOLD ~1 BE CALLED"),
    (1.3, "MOD|META|SAYS|CALLED|write|test ~6 CITED"),
    (1.3, "CITED ~4 MOD|META|BE"),
    (0.6, "HIT laughing|lachen|rire|risa|ridere"),
    (0.8, "MOD ~8 MOD ~8 TOLD"),
    (0.8, "MOD ~8 TOLD ~8 MOD"),
    (0.8, "TOLD ~8 MOD ~8 MOD"),
    # the speaker
    (0.75, "SELF BE ~3 INSULTS"),
    (0.75, "SELF DET? INSULTS"),
    (0.75, "SELF FEEL ~2 INSULTS"),
    (0.75, "INSULTS SELF BE"),
    # things
    (0.6, "THING BE? ~2 OPEN"),
    (0.6, "THING ~2 BE ~3 OPEN"),
    (0.6, "IT BE ~1 OPEN"),
    (0.6, "^ IT OPEN"),
    (0.6, "OPEN OF DET? THING"),
    (0.6, "DET|WHAT PEJ? HEAP? OF? OPEN THING"),
    (0.6, "AIMED|OPEN DET|IT PEJ|MILD? THING"),
    (0.6, "NAMED THING"),
    (1.1, "AIMED PEJ|DET? THING $"),
]

#: Fields too common to start a machine.
_COMMON = frozenset("YOU YOUARE YOUOBJ ARE YOUR SELF THEY ROLE WHO DET BE AND OF ONLY NEG WILL LIKE KEEP OUT AWAY WHAT TAKE INTO SHOULD KNOW WHERE THING HAVE SEE GIVES FOLK PERSONS THEM UNKNOWN MILD OURS EVERYBODY LURE BELONG THAT SUCH HOME PICS REJECT NONE".split())


@dataclass(frozen=True)
class Step:
    """One part of a machine: symbols, an arbitrary word (``symbols`` None) or an edge of the clause (``at_edge``)."""

    symbols: frozenset[str] | None
    optional: bool
    at_edge: bool = False


@dataclass(frozen=True, eq=False)
class Machine:
    out: str
    weight: float
    steps: tuple[Step, ...]
    negates: bool
    directed: bool
    named: bool
    pattern: str

    @property
    def as_read(self) -> dict[str, float]:
        """A hit of the machine as context transducers read it."""
        insults = ["INSULTS"] if self.out == "abusive" and not self.directed else []
        return dict.fromkeys(["HIT", *insults, *(["AIMED"] if self.directed else ["TOLD", "NAMED"] if self.named else ["TOLD"] if self.out == "sexual" else ["TOLD", "OPEN"])], 0.0)

    @property
    def needs(self) -> list[frozenset[str]]:
        return [s.symbols for s in self.steps if s.symbols and not s.optional]


def _symbol(part: str) -> str:
    return part if part.isascii() and part.isupper() else "=" + plain(part)


_NOT = frozenset({"NEG", "NOBODY", *("=" + w for w in "not never no pas nunca jamais nie mai nobody".split())})


def _compile(out: str, weight: float, pattern: str) -> Machine:
    steps: list[Step] = []
    directed = pattern.startswith("<")
    for w in pattern.lstrip("<").split():
        if w in "^$":
            steps.append(Step(None, False, True))
        elif w[0] == "~":
            steps += [Step(None, True)] * int(w[1:])
        else:
            optional = w.endswith("?")
            steps.append(Step(frozenset(_symbol(c) for c in w.rstrip("?").split("|")), optional))
    said = frozenset(x for s in steps if s.symbols and not s.at_edge for x in s.symbols)
    return Machine(out, weight, tuple(steps), bool(said & _NOT), directed or bool(said & {"YOU", "YOUR", "YOUARE", "YOUOBJ", "SELFPRON", "HURT"}), bool(said & {"WHO", "PEOPLE", "THEM", "GROUP", "FOLK"}), pattern)


def _guess(token: str) -> dict[str, float]:
    """Symbols of a word outside the lexicon by its form: any word, and one formed like the name of a people."""
    if len(token) < 4 or not token.isalpha():
        return {}
    people = len(token) > 6 and token.endswith(("ish", "ischen", "ische", "iches", "ians", "ese"))
    return {"UNKNOWN": 0.0, "ETHNONYM": 0.0} if people else {"UNKNOWN": 0.0}


Arcs = list[list[tuple[int, dict[str, float]]]]


class Grammar:
    """The cascade: lexicon, phrase, clause and context transducers, and which of them a clause can start."""

    def __init__(self, remembered: int = 200_000) -> None:
        self.phrases = [_compile(out, -cost, p) for out, cost, p in PHRASES]
        self.machines = [_compile(kind, w, p) for kind, listed in CLAUSES.items() for w, p in listed]
        self.contexts = [_compile("", w, p) for w, p in CONTEXTS]
        every = [*self.phrases, *self.machines, *self.contexts]
        words: dict[str, set[str]] = {}
        for name, listed in FIELDS.items():
            for w in forms(listed):
                words.setdefault(plain(w), set()).add(name)
        used = {x for m in every for s in m.steps for x in s.symbols or ()}
        for x in used:
            if x[0] == "=":
                words.setdefault(x[1:], set()).add(x)
        self.lexicon = Lexicon(words, guess=_guess)
        names = sorted(used | {"UNKNOWN", "ETHNONYM"} | {m.out for m in self.phrases})
        self.bit = {x: 1 << k for k, x in enumerate(names)}
        self.needs = {id(m): [self._bits(n) for n in m.needs] for m in every}
        derived = {m.out for m in self.phrases}
        #: machines by the symbols of the need that starts them: one made of rarer symbols, if any
        self.starts: dict[int, list[Machine]] = {}
        for m in self.machines:
            rare = [n for n in m.needs if not n & _COMMON]
            for x in min(rare, key=lambda n: (bool(n & derived), len(n))) if rare else m.needs[-1]:
                self.starts.setdefault(self.bit[x], []).append(m)
        self.start_bits = sum(self.starts)
        self.phrase_starts = [(self._bits(next((n for n in m.needs if not n & _COMMON), m.needs[-1])), m) for m in self.phrases]
        #: symbols that some phrase or clause machine cannot do without
        self.needed = 0
        for m in [*self.phrases, *self.machines]:
            for n in self.needs[id(m)]:
                self.needed |= n
        self.remembered = remembered
        self._masks: dict[str, tuple[int, bool, bool, bool]] = {}
        self._plans: dict[int, tuple[list[Machine], list[Machine]] | None] = {}
        self._clauses: dict[str, tuple[float, str]] = {}

    def _bits(self, symbols) -> int:
        out = 0
        for x in symbols:
            out |= self.bit.get(x, 0)
        return out

    # --- which machines can start

    def _word_bits(self, *words: str) -> int:
        return self._bits(x for w in words for x in self.lexicon.words.get(w, ()))

    def _token(self, t: str) -> tuple[int, bool, bool, bool]:
        """Every symbol a token may read as, whether it can be the first or second of two that read as one, and part of a spelled word."""
        read = self.lexicon.read
        bits = self._bits(read(t)) | self._bits(_guess(t)) | self._word_bits(*self.lexicon.run_together(t) or ())
        if "_" in t:
            bits |= self._bits(read(t.replace("_", "")))
        return bits, self.lexicon.may_open(t), self.lexicon.may_close(t), len(t) == 1 or "_" in t

    def mask(self, text: str) -> int:
        """All symbols that the lattice of a clause may hold, or more."""
        masks, lexicon = self._masks, self.lexicon
        tokens = tokens_of(text)
        out, last, letters = 0, None, 0
        for t in tokens:
            got = masks.get(t)
            if got is None:
                if len(masks) >= self.remembered:
                    masks.clear()
                got = masks[t] = self._token(t)
            bits, opens, closes, letter = got
            out |= bits
            letters += letter
            if closes and last is not None:
                if last + t in lexicon.words:
                    out |= self._word_bits(last + t)
                for two in lexicon.slipped(last, t):
                    out |= self._word_bits(*two)
            last = t if opens else None
        if letters and letter_by_letter(tokens):
            for _, _, symbols in lexicon.lattice(text)[1]:
                out |= self._bits(symbols)
        return out

    def plan(self, mask: int) -> tuple[list[Machine], list[Machine]] | None:
        """Phrase and clause machines whose every need the symbols meet."""
        mask &= self.needed
        if mask in self._plans:
            return self._plans[mask]
        if len(self._plans) >= self.remembered:
            self._plans.clear()
        needs, phrases, have = self.needs, [], mask
        for first, m in self.phrase_starts:
            if first & have and all(n & have for n in needs[id(m)]):
                phrases.append(m)
                have |= self.bit[m.out]
        left, listed = have & self.start_bits, {}
        while left:
            one = left & -left
            left ^= one
            for m in self.starts[one]:
                if id(m) not in listed and all(n & have for n in needs[id(m)]):
                    listed[id(m)] = m
        machines = list(listed.values())
        got = self._plans[mask] = (phrases, machines) if machines else None
        return got

    # --- paths

    @staticmethod
    def paths(m: Machine, n: int, arcs: Arcs, pauses: set[int], pause: float) -> dict[tuple[int, int], float]:
        """Least cost of the machine's paths through the lattice by where they begin and end."""
        steps, last = m.steps, len(m.steps)
        first = steps[0]
        begins = range(n)
        if first.symbols and not first.optional:
            begins = [p for p in range(n) if any(not first.symbols.isdisjoint(s) for _, s in arcs[p])]
        found: dict[tuple[int, int], float] = {}
        table: dict[int, dict[tuple[int, int], float]] = {p: {(0, p): 0.0} for p in begins}
        for at in range(n + 1):
            here = table.pop(at, None)
            if not here:
                continue
            edge = at == 0 or at == n or at in pauses
            todo = list(here)
            while todo:
                key = todo.pop()
                k, begin = key
                cost = here[key]
                if k == last:
                    old = found.get((begin, at))
                    if old is None or old > cost:
                        found[(begin, at)] = cost
                    continue
                step = steps[k]
                if step.optional or step.at_edge and edge:
                    old = here.get((k + 1, begin))
                    if old is None or old > cost:
                        here[(k + 1, begin)] = cost
                        todo.append((k + 1, begin))
                if step.at_edge or at == n:
                    continue
                inside = pause if at in pauses and at != begin else 0.0
                for to, symbols in arcs[at]:
                    if step.symbols is None:
                        if to != at + 1:
                            continue
                        more = GAP + inside
                        if not m.negates and "NEG" in symbols:
                            more += NEGATED
                        if "CALLED" in symbols or "NICE" in symbols:
                            more += NEGATED
                        if m.out == "abusive" and not m.negates and "SELF" in symbols:
                            more += SELF
                    else:
                        hit = [symbols[s] for s in step.symbols if s in symbols]
                        if not hit:
                            continue
                        more = min(hit) + inside
                        if m.out == "abusive" and not m.named and "BE" in step.symbols and "SELF" in symbols:
                            more += SELF
                    there = table.setdefault(to, {})
                    now = cost + more
                    old = there.get((k + 1, begin))
                    if old is None or old > now:
                        there[(k + 1, begin)] = now
        return found

    def clause(self, text: str) -> tuple[float, str]:
        """Score and kind of a clause in plain text."""
        if is_unspaced(text):
            text = self.lexicon.segmented(text)
        plan = self.plan(self.mask(text))
        if plan is None:
            return 0.0, ""
        n, edges, pauses, quoted = self.lexicon.lattice(text)
        arcs: Arcs = [[] for _ in range(n + 1)]
        have = 0
        for a, b, symbols in edges:
            if symbols:
                have |= self._bits(symbols)
            arcs[a].append((b, symbols))
        plan = self.plan(have)
        if plan is None:
            return 0.0, ""
        phrases, machines = plan
        for m in phrases:
            for (a, b), cost in self.paths(m, n, arcs, pauses, PAUSE).items():
                if a != b and cost < 0.5:
                    arcs[a].append((b, {m.out: cost - m.weight}))
        score, kind = 0.0, ""
        for m in sorted(machines, key=lambda m: -m.weight):
            if m.weight <= score:
                break
            for (a, b), cost in self.paths(m, n, arcs, pauses, PAUSE).items():
                now = m.weight - cost
                if now > score and now >= THRESHOLD / 4:
                    now -= self._taken(m, a, b, n, arcs, pauses, quoted)
                    if now > score:
                        score, kind = now, m.out
        return max(score, 0.0), kind if score > 0 else ""

    def _taken(self, hit: Machine, a: int, b: int, n: int, arcs: Arcs, pauses: set[int], quoted: set[int]) -> float:
        """What the context of a hit takes from its score."""
        around = list(arcs)
        cited = {"CITED": 0.0} if quoted and quoted.issuperset(range(a, b)) and len(quoted) < n else {}
        around[a] = [*arcs[a], (b, hit.as_read | cited)]
        have = 0
        for arc in around:
            for _, symbols in arc:
                if symbols:
                    have |= self._bits(symbols)
        most = 0.0
        for m in self.contexts:
            if m.weight <= most or hit.negates and m.steps[0].symbols and "NEG" in m.steps[0].symbols:
                continue
            if all(x & have for x in self.needs[id(m)]):
                for cost in self.paths(m, n, around, pauses, 4 * PAUSE).values():
                    most = max(most, m.weight - cost)
        return most

    def _known_clause(self, key: str) -> tuple[float, str]:
        known = self._clauses
        got = known.get(key)
        if got is None:
            got = self.clause(key)
            if len(key) <= 200:
                if len(known) >= self.remembered:
                    known.clear()
                known[key] = got
        return got

    def document(self, text: str) -> tuple[float, str, int]:
        """Greatest score, its kind and the number of clauses at the threshold or above.

        Clauses end with the line; one that runs on is read whole as well, and counts if none of its lines does.
        """
        score, kind, hits = 0.0, "", 0
        meant = plain(text)
        for c in clauses(meant):
            got = self._known_clause(c.strip())
            if got[0] > score:
                score, kind = got
            hits += got[0] >= THRESHOLD
        for parts in wrapped(text, meant) if "\n" in text else ():
            got = max((self._known_clause(p) for p in pieces(parts)), key=lambda x: x[0])
            if got[0] > score:
                score, kind = got
            hits += got[0] >= THRESHOLD and not any(self._known_clause(p)[0] >= THRESHOLD for p in parts)
        return min(score, 1.0), kind, hits


@functools.lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("n_clauses", T.IntegerType())])


@F.arrow_udf(_SCORED)
def _scored(a: pa.Array) -> pa.Array:
    g = grammar()
    rows = [g.document(t) if t else (0.0, "", 0) for t in texts(a)]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] or None for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["score", "kind", "n_clauses"])


def score(df: DataFrame, text: str, name: str = "abuse") -> DataFrame:
    """``df`` with struct ``name``: score (0 to 1), kind (abusive, hateful, sexual or null), n_clauses.

    Null, empty and blank texts score 0. A column of the same name is replaced.
    """
    return df.withColumn(name, _scored(F.col(f"`{text}`")))
