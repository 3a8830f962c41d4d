"""Semantic fields that the clause transducers read: words of several languages by what they mean.

Words are written without accents. A slash marks a rule of inflection, so that
forms are made, not listed: ``/n`` English nouns, ``/v`` English verbs, ``/w``
those that double the last letter, ``/d`` German adjectives, ``/e`` German nouns
in -en, ``/o`` Romance endings, ``/f`` French endings, ``/s`` a plain -s, ``/c``
Romance infinitives with the pronouns they take. A word may stand in several fields.
"""

from __future__ import annotations


def _noun(w: str) -> list[str]:
    return [w, w[:-1] + "ies" if w.endswith("y") and w[-2:-1] not in "aeiou" else w + ("es" if w.endswith(("s", "x", "ch", "sh")) else "s")]


def _verb(w: str) -> list[str]:
    stem = w[:-1] if w.endswith("e") else w
    return [*_noun(w), stem + "ed", stem + "ing", stem + "in"]


def _double(w: str) -> list[str]:
    return [w, w + "s", w + w[-1] + "ed", w + w[-1] + "ing"]


RULES = {
    "n": _noun,
    "v": _verb,
    "w": _double,
    "d": lambda w: [w + e for e in ("", "e", "er", "es", "en", "em")],
    "e": lambda w: [w, w + "e", w + "en"],
    "o": lambda w: [w + e for e in ("o", "a", "os", "as", "i", "e")],
    "f": lambda w: [w + e for e in ("", "e", "s", "es")],
    "s": lambda w: [w, w + "s"],
    "c": lambda w: [w, *(w + e for e in ("te", "me", "la", "lo", "los", "las", "ti", "mi")), *(w[:-1] + e for e in ("rti", "rmi", "rli", "rlo"))],
}


def forms(listed: str) -> list[str]:
    out: list[str] = []
    for w in listed.split():
        word, _, rule = w.partition("/")
        out += RULES[rule](word) if rule else [word]
    return out


FIELDS = {
    # who
    "YOU": "you u ya yall youre yourself yourselves urself du dich dir ihr euch tu te toi vous ti usted ustedes vosotros voi voce voces ty cie ciebie tobie jij jou jullie sen seni ты тебя тебе тобой вы вас вам انت انتي 你 你们 您 お前 貴様 너",
    "YOUOBJ": "te ti dich dir euch vous vi os cie ciebie тебя вас seni",
    "ARE": "eres bist seid sois sei siete sos jestes",
    "YOUR": "your ur yours dein/d deins euer eure euren ton ta tes votre vos tu tus vuestro tuo tua tuoi tue vostro twoj twoja twoje твой твоя твои твою teu jouw",
    "SELF": "i im ive me my myself mine we us our ich mich mir mein/d wir uns je j moi mon ma mes nous yo mi soy estoy suis bin jestem nosotros io mio mia noi sono ja mnie mam я меня мне мы eu ik",
    "THEY": "he she they him her them his their who whoever someone somebody everyone everybody er wer il elle ils elles qui lui lei loro chi quien on ona oni он она они кто",
    "ROLE": "guy/n dude/n man woman men person people boss/n manager/n management maintainer/n reviewer/n author/n developer/n programmer/n coder/n admin/n moderator/n user/n colleague/n coworker/n neighbour/n lead team crew company chef/s kollege kollegen kerl typ leute mensch entwickler nachbar mec type patron collegue/s voisin equipe jefe/s tio tipo compañero companero persona equipo gente capo collega tizio persona szef szefa начальник автор",
    "KIN": "mother mom mum mama father dad family parents children kids sister brother wife daughter son mutter vater familie eltern kinder schwester frau mere pere famille parents enfants soeur femme madre padre familia hijos hermana mujer famiglia figli sorella moglie matka matke мать мама семья дети",
    "ONE": "bunch pack lot pair gang herd bande haufen tas bande banda panda branco",
    # what things are called that may be cursed at will
    "IT": "it this that es das ça ca esto questo to это",
    "THING": "code/s parser/n compiler/n linker/n script/n makefile/n patch/n commit/n build/s server/n framework/n library libraries function/n test/n tool/n bug/n error/n warning/n format/n file/n module/n driver/n program/n software editor machine/n computer/n screen keyboard/n disk/n network link/n log/n cache/n api/s system/n terminal/n interface/n protocol/n report/n region/n status restart/v retry batch/n switch/n interpreter pipeline/n branch/n merge process/n thread/n pointer/n table/n documentation manual spec regex hash/n dependency dependencies project/n job/n node/n task/n "
    "programm skript bibliothek datei fehler server rechner drucker programme bibliotheque fichier/s erreur/s serveur compilateur format/s pointeur programa archivo/s biblioteca error/s errores servidor compilador formato modulo codigo libreria programma compilatore file errore errori",
    # insults
    "INSULT": "asshole/n arsehole/n bastard/n bitch/n dickhead/n scumbag/n cunt/n twat/n prick/n wanker/n whore/n slut/n dumbass/n dipshit/n shithead/n motherfucker/n fucker/n fuckface/n retard/n halfwit/n nitwit/n dimwit/n numbskull/n bellend/n tosser/n douchebag/n douche jackass/n loser/n idiot/n moron/n imbecile/n cretin/n lowlife/n simpleton/n dunce/n jerk/n blockhead/n airhead/n dullard/n muppet/n pillock/n plonker/n git scum knobhead/n fuckwit/n arsewipe/n asswipe/n creep/n weirdo/n psycho/n degenerate/n pervert/n incel/n bimbo skank/n hoe hag sissy wuss crybaby jerkoff pisshead sonofabitch turd/n shitstain/n subhuman/n pussy "
    "arschloch arschlocher vollidiot/e drecksack drecksacke schwachkopf schwachkopfe wichser hurensohn hurensohne missgeburt/e trottel vollpfosten spast/e dreckskerl/s fotze/n schlampe/n blodmann dummkopf dummkopfe vollhorst miststuck arschgesicht arschgeige penner depp/e versager idiot/e idiotin kotzbrocken scheisskerl volltrottel nichtsnutz schweinehund wichtigtuer hornochse pissnelke assi spinner hure/n nutte/n saftsack opfer mistkerl lump bastarde "
    "connard/s connasse/s abruti/f salaud/s salope/s encule/f batard/f debile/s ordure/s crevard/f bouffon/s bouffonne idiot/f cretin/f imbecile/s couillon/s tocard/f pouffiasse putain/s petasse raclure trouduc tete-de-con blaireau mongol/f gogol andouille crapule fumier minus tarlouze enfoire/f "
    "gilipollas imbecil imbeciles idiota/s estupid/o pendej/o capull/o malparid/o subnormal/s cabron cabrona cabrones cabronazo mamon mamones zorra/s desgraciad/o payas/o hijoputa soplapollas pelotud/o boludo/s cretin/o tarado/s mongol/o sinverguenza canalla baboso huevon lameculos perdedor mierdecilla "
    "stronz/o coglione coglioni bastard/o scem/o deficiente deficienti troia troie puttana puttane testa-di-cazzo minchione pirla rincoglionit/o sfigat/o fallit/o zoccola merdaccia stupidotto imbecilli imbecille cretin/o idioti "
    "debil debilu debile kretyn/s kretynka dupek skurwysyn/s idiota idiotka palant gnoj suka szmata frajer cwel kurwa klootzak/e eikel/s hoer kankerlijer sukkel lul trut aptal salak serefsiz orospu otari/o burro corno palhac/o babaca cuzao vadia viado arrombado filho-da-puta "
    "идиот идиоты идиотка дебил дебилы мудак мудаки сука суки ублюдок ублюдки сволочь тварь твари кретин придурок придурки козел мразь тупица урод уроды скотина дура дурак чмо шлюха гнида غبي حمار كلب حقير احمق 傻逼 傻屄 白痴 笨蛋 蠢货 混蛋 王八蛋 贱人 废物 人渣 馬鹿 馬鹿野郎 バカ野郎 バカ アホ クズ クズ野郎 間抜け 병신 멍청이 바보 개새끼",
    "HARD": "asshole/n arsehole/n dickhead/n scumbag/n cunt/n twat wanker/n motherfucker/n fuckface shithead/n dipshit arschloch arschlocher drecksack wichser hurensohn hurensohne fotze schlampe missgeburt connard/s connasse salope/s encule/f salaud gilipollas cabron hijoputa skurwysyn stronz/o coglione мудак ублюдок sonofabitch 傻逼 傻屄 王八蛋 개새끼",
    "BEAST": "clown/n rat/n weasel/n pig/n dog/n cow/n ape/n monkey/n donkey/n goat/n sheep worm/n maggot/n snake/n toad/n troll/n swine cockroach/n rodent/n parasite/n leech/n fool/n coward/n joke/n lump disgrace embarrassment brat/n slob/n hyena/n vulture/n liar/n witch/n nobody animal/n creature/n thief failure/n excuse "
    "schwein/e sau hund/e ratte/n affe/n esel kuh tier feigling/e clown/s wurm schlange parasit/e witz null ziege "
    "chien/f porc/s rat/s singe/s ane/s vache/s clown/s lache/s ver truie cafard/s menteur/s "
    "rata/s perr/o cerd/o burr/o animal/s vaca/s gusano/s cobarde/s serpiente cucaracha/s bestia/s mentiros/o asno "
    "maial/o porc/o asin/o cane cani ratto topo verme vigliacc/o bestia bugiard/o scimmia pagliacci/o swinia osiol menda баран осел свинья собака крыса клоун",
    "PERSONS": "man woman men women person people human/n being/n creature/n thing kid/n child fellow guy/n soul coder/n programmer/n developer/n maintainer/n reviewer/n boss girl/n boy/n mensch kerl typ weib frau/s type mec homme femme persona persone tipo tio hombre mujer uomo donna",
    "PEJ": "stupid stupidest dumb dumber dumbest idiotic moronic pathetic worthless useless brainless spineless gutless braindead retarded incompetent clueless ignorant filthy rotten disgusting vile ugly lying miserable pitiful cowardly witless mindless demented deranged fucking fuckin goddamn bloody repulsive despicable revolting loathsome subhuman contemptible snivelling slimy sleazy pompous arrogant whiny imbecilic cretinous daft gormless "
    "dumm/d dumms dummst/d blod/d bescheuert/d hirnlos/d erbarmlich/d widerlich/d ekelhaft/d wertlos/d nutzlos/d unfahig/d lacherlich/d armselig/d verlogen/d dreckig/d behindert/d jammerlich/d minderbemittelt/d feig/d bekloppt/d bloder verdammt/d verkommen/d schabig/d "
    "stupide/s con cons conne/s debile/s minable/s pathetique/s inutile/s degueulasse/s repugnant/f ignoble/s bete/s nul/f lamentable/s incapable/s ridicule/s meprisable/s abject/f ecervele/f "
    "estupid/o tont/o idiota/s imbecil inutil/s asqueros/o patetic/o despreciable/s repugnante/s ridicul/o lel/o bob/o subnormal ignorante/s miserable/s cobarde/s maldit/o penos/o torpe/s "
    "stupid/o scem/o inutile inutili schifos/o patetic/o ridicol/o incapace incapaci ignorante ignoranti lurid/o vigliacc/o miserabile spregevole disgustos/o idiota cretin/o "
    "glupi glupia tepy tepa beznadziejny zalosny zalosna тупой тупая тупые глупый жалкий жалкая мерзкий aptal burr/o nojent/o ridicul/o dom domme achterlijk/d",
    "MILD": "lazy dirty fat little lousy sorry sad sick thick dense hopeless shitty crappy smelly stinking nasty corrupt creepy whining twisted ridiculous weak old cheap poor grosse gros gross/d dick/d fett/d hasslich/d mies/d faul/d alt/d klein/d dreckig/d stinkend/d scheiss beschissen/d elend/d sale/s pauvre/s petit/f vieux vieille grosses gord/o fe/o suci/o vag/o viej/o put/o miser/o grass/o brutt/o sporc/o vecchi/o piccol/o",
    "FILTH": "shit crap filth trash garbage dung scum rubbish dirt scheisse dreck mull abschaum scheiss merde ordure/s dechet/s mierda basura escoria porqueria merda spazzatura feccia lixo gowna gowno smiec говно дерьмо мусор",
    "HEAP": "piece pile sack bag heap lump waste excuse stuck haufen sack morceau tas sac pedazo trozo saco pezzo sacco pedaco kawal кусок",
    "LIFE": "oxygen space skin air breath carbon flesh life sperm",
    "OF": "of for de da di del von d",
    "DET": "a an the such this that these those some any ein/d der die das dieser diese dieses so un une des le la les ce cet cette ces el los las este esa ese unos una esos esas gli il lo i questo questa quel quegli ten ta to een",
    "BE": "be am is are was were been being s re bin ist sind war waren bist seid est es suis sont sommes etes son ser eres sois sei siete sono jest jestes sa 是 は",
    "AND": "and und et y e und",
    "ONLY": "only nur seul seulement solo solamente nothing just but rien qu que als",
    "WHAT": "what such how quel quelle que vaya menudo was che welch jaki какой",
    "HEY": "hey oi listen look congratulations hor ecoute oye mira ascolta ehi słuchaj слушай",
    "BODYBAD": "shut halt ferme fermez cierra callate chiudi zamknij cala cale хватит",
    "MOUTH": "mouth trap face hole gob piehole cakehole maul fresse klappe schnauze mund gueule bouche boca pico hocico bocca becco morde pysk gębę рот пасть bek",
    "MIND": "brain/n intelligence iq mind sense wit/s hirn gehirn verstand cerveau intelligence cerebro inteligencia neuronas cervello intelligenza mozg мозг мозги мозгов",
    "NONE": "no zero without lacks lack lacking missing tiny pea empty half little less kein/d ohne aucun sans sin ningun niente senza bez нет",
    "SHAME": "shame ashamed embarrass/v embarrassment disgrace/v schame schamen schamt scham honte averguenza averguenzate verguenza vergogna vergognati vergognarti wstyd wstydz стыдно",
    # rejecting a person
    "NOBODY": "nobody noone none keiner niemand personne nadie nessuno nikt никто",
    "EVERYBODY": "everyone everybody all world alle jeder tout todos todo tutti wszyscy все",
    "CARE": "respect/v like/v love/v miss misses missed need/v want/v loves cry cries mourn/v mag mogen vermisst vermissen braucht aime regrette regrettera respecte veut quiere extranara respeta necesita aguanta vuole sopporta rispetta",
    "SCORN": "hate/v despise/v loathe/v detest/v laugh/v laughs mock/v pity pities hasst hassen lacht lachen verachtet deteste meprise detestent odia odian desprecia desprecian odiano disprezza nienawidzi ненавидит ненавидят ненавижу",
    "FAREWELL": "fuck piss sod bugger naff verpiss verpisst hau schleich zieh verschwinde verschwindet fous foutez casse degage degagez tire barre largate vete lárgate larguense vattene sparisci levati spierdalaj wypierdalaj spieprzaj отвали вали проваливай 滚 滚蛋 滚开 消えろ 꺼져",
    "SILENCE": "stfu callate callese cierrala fermela tais taisez zamknij заткнись заткнитесь zitto zitta 闭嘴 黙れ 닥쳐 اخرس calati",
    "PLACE": "project/n repo/s repository channel team tracker forum list here projekt kanal hier projet canal depot ici proyecto aqui progetto qui projektu проекта",
    "AWAY": "off out lost away ab weg leine",
    "HELL": "hell diable enfer teufel holle infierno diablo carajo inferno diavolo pieklo ад",
    "LAIR": "hole rock cave gutter sewer swamp loch kanalisation trou egout agujero cueva alcantarilla buco fogna tana",
    "CHILDISH": "crayon/n sandbox kindergarten nursery dolls toys legos playground diapers preschool spielplatz sandkasten windeln maternelle guarderia asilo pannolini",
    "CRAWL": "crawl/v slither/v kriech/d rampe rampez arrastrate striscia",
    "FIRE": "fired sacked",
    # death and harm
    "DIE": "die dies dead dying perish croak sterben stirb sterbt krepier/d verreck/d verreckst crever creve crevez mourir meurs mourrez muere muerete mueras morir morirte crepa crepi morire muori umrzyj zdechnij сдохни сдохните умри 去死 死ね くたばれ 죽어",
    "SUICIDE": "kys matate suicidate ammazzati ucciditi 去死 死ね くたばれ",
    "ENDSELF": "kill hang shoot end drown stab bring hang/d erhang/d erschiess/d tote hang suicide pends pendre tuer tue flingue ahorca ahorcate pegate mata impiccati sparati buttati zabij повесься убейся",
    "SELFPRON": "yourself yourselves urself dich euch auf um te toi vous ti sie",
    "JUMP": "jump leap throw spring/d saute jette jetez salta tirate lanzate buttati saltar skocz прыгни",
    "HEIGHT": "bridge/n roof/n cliff/n building/n window/n train/n balcony brucke dach klippe fenster zug pont toit falaise fenetre train puente tejado azotea ventana tren ponte tetto finestra treno most mostu dachu мост крыша",
    "POISON": "bleach poison glass cyanide acid gift javel poison lejia veneno candeggina veleno",
    "DRINK": "drink swallow eat gulp trink schluck bois avale bebe bebete traga bevi mangia",
    "WISH": "hope wish hoffe hoffentlich wunsche wunsch espere souhaite espero ojala deseo spero auguro mam życzę надеюсь желаю чтоб чтобы",
    "WOE": "die dies cancer starve/v suffer/v rot/w burn/v choke/v crash/v bleed/v aids hanged raped killed shot fired sacked hurt/s drown/v perish miserably jail verreck/d verreckst krepier/d krepierst stirbst sterbt krebs leidest verlierst mourir creves meures crever cancer souffres souffrir souffrances mueras muera mueran cancer sufras pudras pudrete atropelle pierdas crepi muoia muori cancro soffra marcisca umrzesz zdechniesz сдохнешь умрешь rak",
    "WILL": "will ll shall gonna going want would should swear werde werd wird wirst will vais va allons allez va voy vas vamos a sto ti zaraz буду",
    "HARM": "kill/v smash/v break/s breaking burn/v beat/s beating punch/v stab/w shoot/s shooting choke/v strangle/v hurt/s crush/v rip/w tear/s tearing slit cut/s gut destroy/v bash/v kick/v knock/v murder/v end skin/s smack/v slap/w hit/s beat slaughter/v butcher/v maim/v poke drown/v rape/v hang/v cripple/v "
    "tote toten schlag/d schlagen brech/d brechen umbringen bring verprugel/n erschlag/d erschiess/d zusammenschlagen hau hauen erwurg/d abstech/d zerstor/d stech/d "
    "tuer casser crever frapper demolir defoncer peter buter etrangler cogner eclater exploser planter massacrer "
    "matar/c partir/c romper/c reventar/c golpear/c quemar/c apunalar/c pegar/c destrozar/c cortar/c arrancar/c ammazzo ammazzare/c spacco spaccare/c uccido uccidere rompo rompere picchio picchiare/c gonfio taglio strappo zabije zabic polamie maak убью убить сломаю изобью порежу придушу 杀 杀了 打死 弄死 殺す ぶっ殺す 殺してやる 殺してやる",
    "BODYPART": "face/s neck/s throat/s finger/n leg/n knee/n teeth tooth head skull/s bone/n nose arm/n eye/n jaw/s ribs guts balls kehle fresse hals zahne knochen beine bein genick gesicht kopf nase finger augen schadel rippen visage figure gueule yeux dents cou jambes os nez tete bras bouche cara cuello dientes piernas huesos cabeza nariz ojos dedos brazos boca faccia denti gambe ossa testa naso occhi dita collo braccia muso zeby nogi leb лицо зубы ноги морду голову",
    "HOME": "live/s address house home sleep/s wohnst wohnt adresse schlafst habites habite adresse dors vives vive viven direccion casa duermes abiti abita vivi indirizzo mieszkasz живешь живете адрес",
    "HAUNT": "school kindergarten work park/s play/s schule ecole escuela colegio scuola lavora",
    "KNOW": "know knows have weiss wissen kenne kennen sais savons connais se sabemos conozco so sappiamo conosco wiem знаю",
    "WHERE": "where wo ou donde dove gdzie где",
    "WATCH": "watch visit/v coming careful find waiting pass vorsicht beobacht/d attention gare cuidado vigilando attento attenzione uwazaj берегись",
    "HUNT": "find track hunt get finden kriegen retrouver trouver choper encontrar/c pillar/c buscar/c trovare/c prendere/c znajde найду",
    "CONSEQ": "regret pay bleed suffer bereuen bezahlen bluten regretter payer saigner arrepentir/c arrepentiras pagaras pagar pentirai pagherai pentirtene pozalujesz пожалеешь ответишь bereust",
    "INJURY": "ambulance hospital wheelchair coffin grave morgue teeth legs graveyard krankenhaus krankenwagen rollstuhl sarg grab hopital ambulance cercueil tombe fauteuil hospital ambulancia ataud tumba ospedale ambulanza bara tomba больница могила",
    "LEAVE": "leave/v walk/v wake/s end land/v breathe carried kommst landest laufst finiras sortiras repartiras acabaras saldras terminaras finirai uscirai",
    "WEAPON": "bullet knife gun axe hammer bomb kugel messer pistole balle couteau flingue bala cuchillo pistola pallottola coltello",
    "INTO": "in into through between at dans en dentro nella in durch",
    "KEEP": "keep touch try if one once say come next wenn noch si encore vuelve vuelves toques sigue se ancora provaci jesli если",
    "BORN": "born aborted swallowed abort abgetrieben avorter avorte nee abortado abortar abortire nata abortito",
    "EXIST": "exist breathe breed breathing born live alive existing existieren leben atmen exister vivre respirer existir vivir respirar esistere vivere respirare",
    "DISGUSTS": "disgust/v repulse/v sicken/v repel/v kotzt ekelst ekelt anekelt degoutes degoute repugnas asqueas disgusti",
    "SICKEN": "sick puke vomit barf throw kotzen vomir gerber vomitar asco schifo vomitare",
    "STINK": "stink/s stinks smell/s smells reek/s stinkst stinkt stinken pues pue puent apestas apesta apestan hueles huelen huele puzzi puzza puzzano smierdzi smierdzisz воняешь воняет",
    "GIVES": "das da fais fait fai fa make makes das machst",
    "LIKE": "like as wie comme como come jak как than als que",
    # groups of people
    "GROUP": "women woman girls females wives immigrant/n migrant/n foreigner/n refugee/n gay/n lesbian/n homosexual/n transsexual/n homos blacks jew/n muslim/n christians hindus catholics gypsy arab/n asians africans mexicans turk/n cripple/n southerner/n northerner/n easterner/n westerner/n unbeliever/n believer/n heathen/n infidel/n natives outsiders peasant/n pensioner/n gypsies "
    "frauen weiber auslander auslandern fluchtling/e fluchtlingen migrant/e asylant/e asylbewerber schwule schwulen lesben homosexuelle homosexuellen jude/n muslime muslimen moslems araber arabern turke/n neger negern schwarze schwarzen zigeuner zigeunern behinderte behinderten rentner "
    "femmes etrangers refugies migrants immigres homosexuels homos gays lesbiennes juifs musulmans arabes noirs africains roms gitans handicapes turcs "
    "mujeres extranjeros inmigrantes refugiados homosexuales gays lesbianas judios musulmanes moros negros gitanos arabes africanos discapacitados "
    "donne stranieri immigrati migranti profughi rifugiati omosessuali lesbiche ebrei musulmani arabi negri neri zingari africani disabili "
    "kobiety cudzoziemcy uchodzcy zydzi geje muzulmanie cyganie женщины мигранты беженцы евреи геи мусульмане цыгане бабы mulheres estrangeiros imigrantes judeus ciganos vrouwen buitenlanders vluchtelingen joden moslims",
    "SLURGROUP": "faggot/n fag/n tranny trannies kike/n spic/n wetback/n chink/n gook/n paki/n raghead/n towelhead/n nigger/n nigga/n dyke/n shemale/n kanake/n schwuchtel/n tunte/n kameltreiber bougnoule/s youpin/s negro-de-mierda tapette/s pede/s maricon maricones bollera/s sudaca/s frocio froci finocchi ricchione negracci pedal pedaly żydek пидор пидоры пидорас хач чурка чурки жид жиды",
    "KINDOF": "black white brown dark skinned coloured jewish muslim gay trans arab african asian old elderly disabled blind deaf poor foreign southern northern eastern western religious",
    "FOLK": "people folk/s persons ones believers men women kids families leute menschen frauen gens personnes hommes femmes gente personas hombres persone uomini люди ludzie",
    "NATION": "nation/n race/n tribe/n ethnic country",
    "DEHUMAN": "vermin parasite/n subhuman/n animal/n cockroach/n rat/s scum filth plague disease cancer savage/n pest/n pestilence infestation garbage trash dirt scourge abomination/n degenerate/n maggot/n leech/n swine ape/n monkey/n barbarian/n beast/n burden "
    "ungeziefer abschaum untermensch/e parasit/e dreck pack gesindel plage pest seuche ratten tiere affen krebsgeschwur "
    "vermine parasite/s rats cafards racaille ordures dechets peste fleau animaux singes sauvages "
    "plaga parasit/o basura escoria ratas cucarachas bestias animales salvajes lacra chusma "
    "parassiti feccia spazzatura topi ratti bestie animali scimmie piaga cancro robactwo bydlo pasozyty паразиты твари звери скот",
    "VICE": "thief thieves liar/n criminal/n rapist/n terrorist/n murderer/n pedophile/n pervert/n crook/n cheat/s cheaters steal/s stealing lie lies stink/s smell rape murder lazy violent dirty stupid dumb inferior primitive uncivilised uncivilized sick perverted disgusting dangerous evil greedy immoral unclean worthless useless filthy retarded backward disturbed unnatural "
    "dieb/e diebin lugner kriminell/d verbrecher vergewaltiger terroristen faul/d krank/d dumm/d blod/d gewalttatig/d stinken stehlen klauen lugen betrugen gefahrlich/d minderwertig/d pervers/d abartig/d widerlich/d "
    "voleur/s menteur/s violeur/s criminel/s terroriste/s paresseux feignants faineants malade/s dangereux inferieur/f betes stupides sales puent volent mentent voleuses pervers "
    "ladron ladrones mentiros/o violadores criminales delincuentes terroristas vag/o enferm/o suci/o inferiores huelen roban apestan pervertid/o degenerad/o violent/o vividores "
    "ladr/o bugiard/o stupratori criminali delinquenti terroristi pigri malat/o sporc/o inferiori puzzano rubano violenti pervertiti zlodzieje brudasy воры лжецы преступники террористы",
    "SHOULD": "should must need/s ought deserve/s have belong/s gehoren gehort sollte sollten soll muss mussen devraient devrait doivent doit faut deberian deberia deben debe hay tienen vanno devono dovrebbero va powinni trzeba должны надо нужно to",
    "EXPEL": "deport/v deported expel/s expelled ban/w banned exterminate/v gas gassed hang/v hanged shoot shot kill/v wiped burn/v burned castrate/v sterilize/v sterilise/v eliminate/v eradicate/v lock/v locked jail/v imprison/v drown/v driven beaten cleansed purged whipped enslaved disappear vanish slaughtered "
    "abgeschoben abschieben vergast vergasen erschossen erschiessen ausgerottet ausrotten rausgeworfen rauswerfen eingesperrt einsperren wegsperren weggesperrt aufgehangt verbrannt verbrennen vertrieben verjagt verschwinden verprugelt kastriert "
    "expulser expulses renvoyer renvoie renvoient chasser chasses enfermer enfermes exterminer gazer bruler tuer pendre virer disparaitre eliminer "
    "echar/c echarlos expulsar/c expulsados encerrar/c encerrados exterminar/c exterminados quemar/c matar/c fusilar/c deportar/c deportados eliminar/c desaparecer colgar/c "
    "cacciati cacciare/c espulsi espellere bruciare/c bruciati sterminare sterminati rinchiudere rinchiusi rimandare rimandiamoli rispedire sparire eliminati wygnac wyrzucic deportowac spalic zabic выгнать убить сжечь депортировать",
    "STRONGEXPEL": "deport/v exterminate/v gas gases hang kill burn castrate sterilize sterilise lynch shoot eradicate vergasen erschiesst abschieben gazer exterminer exterminar/c fusilar/c sterminare",
    "OUT": "out back home away rid raus heim dehors fuera afuera via won вон 出て行け 滚出",
    "PUT": "send/s ship/s put throw kick get keep drive push load round clean beat schick/d werft jagt renvoyer foutre mandar/c echar/c rimandare cacciare mandiamo",
    "CONFINE": "camp/n cage/n fence/s bars prison/n jail oven/n zoo kitchen kitchens field fields lager gefangnis kuche ofen kafig cuisine camp/s prison/s cage/s four fourneaux cocina jaula/s carcel horno cucina campo gabbia galera forno kuchni кухне",
    "BELONG": "belong/s stay place gehoren gehort place/s lugar quedarse queden quedense posto restare stare miejsce место",
    "BORDER": "border country land ship ships sea neighbourhood neighborhood street town landes pays mer bateau pais barco mare nave kraju fire haus gas",
    "RIGHTS": "rights vote jobs respect rechte droits derechos diritti prawa права trust trusted allowed hire hired work accepted human place life",
    "REJECT": "want wants trust hire need allow like likes accept tolerate will wollen mogen veut veulent voulons queremos quiero quieren vogliamo voglio nie-chcemy хотим",
    "ESSENCE": "blood genes nature dna natur blut gene nature sang naissance naturaleza sangre natura sangue naturze",
    "BREED": "breed/s breeding multiply vermehren reproduisent reproducen riproducono",
    "TAKE": "steal/s stealing take/s taking ruin/s ruined destroy/s poison/s control/s own/s infest/s invade/s flood/s suck/s rob/s kontrollieren stehlen vergiften controlent controlen sucent volent envahissent controlan roban invaden controllano rubano invadono",
    "OURS": "our the us everything media banks world jobs country unser unsere geld banken nos notre banques tout nuestro nuestros trabajos bancos nostro nostri lavoro banche all alles",
    "HATE": "hate/v despise/v loathe/v detest/v hasse hassen verachte deteste hais odio detesto desprecio nienawidze ненавижу",
    "INFERIOR": "inferior lesser lower minderwertig/d inferieur/f inferior/s inferiore inferiori",
    # sexual
    "SEXBODY": "pussy pussies cock/s dick/s tit tits titties boob/s clit muschi mose schwanz titten votze kitzler chatte bite nichons teub tetas coño cono polla verga pito figa cazzo tette fica cycki cipka kutas сиськи член хуй buceta pau peitos kut pik おっぱい",
    "EROT": "nipple/n vagina penis genitals ass arse butt breast/s bosom thigh/n crotch lap body skin neck lips nipple/n buttocks inch brust bruste brusten arsch po schenkel korper haut hintern seins cul fesses cuisses corps peau levres culo pechos muslos cuerpo piel pezones nalgas seno seni cosce corpo pelle capezzoli",
    "SEXV": "fuck/v suck/v lick/v ride riding rode bang shag/w hump/v grope/v fondle/v caress/v caressed stroke/v penetrate/v ficken fick gefickt fickst blasen lutschen lecken bumsen vogeln rammeln baiser sucer lecher niquer branler caresser caressait lechait follar/c chupar/c mamar/c lamer/c lamiendo chupame chupamela scopare/c leccare/c succhiare/c succhiami ruchac трахать трахну sexen",
    "KISS": "kiss/v touch/v lick/v squeeze/v grab/w suck/v bit stroke/v caress caresses kusse kussen kusste streichel/d beruhr/d embrasser embrassait caresser touchait toucher besar/c besaba acariciar/c acariciaba tocar/c agarrar/c baciare baciava accarezzare toccare/c",
    "EXPLICIT": "blowjob/n handjob/n rimjob/n gangbang/n threesome/n cumshot/n creampie/n deepthroat bukkake masturbate/v orgasm/n orgy orgies dildo/n fellatio cunnilingus milf/n horny cumslut jizz porno/s pornos orgasmus wichsen fellation partouze mamada/s mamadas pompino pompini orgia orgasmo/s edizon 裸聊 做爱 口交 セックスしたい フェラ 섹스하자 エロ動画 裸体视频",
    "AROUSED": "horny aroused wet hard throbbing dripping geil/d feucht bande mouillee excite excitee caliente/s cachond/o mojada excitad/o arrapat/o eccitat/o bagnata napalony",
    "NAKED": "naked nude/n undressed topless nackt/d nackten nu nue nus nues poil desnud/o nud/o goly gola голая голые",
    "NAKEDPICS": "nudes nacktbilder nacktfotos nacktvideos nackedeis",
    "UNDRESS": "undress/v strip/w disrobe auszieh/d ausziehen deshabiller deshabille desnudar/c quitarte spogliare/c spogliati rozbierz",
    "CLOTHES": "panties knickers underwear bra blouse shirt dress pants skirt trousers clothes thong stitch hoschen slip bh bluse hose kleid unterwasche culotte soutien chemisier jupe robe bragas sujetador blusa falda ropa tanga vestido mutande reggiseno camicetta gonna vestiti",
    "PULLOFF": "pull/v pulled tear tore torn rip ripped take took slid slide slip slipped off down zieh zog riss arracha arracher enlever enleva quitar/c arrancar/c quito strappare togliere tolse",
    "MOAN": "moan/v gasp scream/v stohn/d stohnte stohnt gemir gemissait gemissant gemit gemir gemia gemir gemeva",
    "PLEASURE": "louder thrust/s pleasure harder more name deeper lust wild plaisir placer piacere laut loud schrei",
    "INSIDE": "inside into deep mouth behind rammed pushed thrust eindrang dedans dentro fondo",
    "SEE": "see show/v send/v sent want watch zeig/d zeige schick/d sehen montre montrez envoie envoyez voir mandame enviame ensename muestrame ver manda mandami fammi mostrami vedere pokaz покажи",
    "PICS": "pic/n picture/n photo/n foto/s video/s camera cam webcam bild/d bilder videos photos fotos camera",
    "PORN": "porn porno xxx hardcore escort/n hooker/n callgirl/n sexcam camgirl/n pornhub nutten huren pute/s putas puttane escort/s prostitute/n erotic erotik sex",
    "SEX": "sex sexo sesso sexe love geschlechtsverkehr seks секс",
    "HAVE": "have had having make made do want hatte haben machen faire fait hacer hicimos tener fare want wanna",
    "WOMEN": "girl/n woman women teen/n babe/n housewife housewives milf/n lady ladies boys chick/n frauen madchen hausfrauen filles femmes chicas mujeres donne ragazze slut/n salopes putas troie singles",
    "LURE": "free live tonight cheap now online click hot near adults uncensored private guaranteed gratis heute kostenlos live wartet warten tabus anmeldung gratuit/f gratuites direct chaudes inscription jour tag baratas barato ciudad limites gratuit gratis vivo dal cam webcam dm anything camera hot waiting",
    "NIGHT": "night morning hard harder until till scream senseless rough anal nacht nuit noche notte desk bed bureau cama mesa letto lap",
    "SEXY": "sexy hottie babe baby honey guapa bella cherie schatzi",
    # context
    "NEG": "not no never neither nor dont isnt arent doesnt didnt wasnt cannot cant wont isn aren don doesn didn wasn weren wouldn couldn hasn haven shouldn kein/d nicht nie niemals pas jamais aucun ni no nunca jamas non mai nie nao не ни нет niet geen 不 没",
    "NICE": "lucky clever smart brilliant funny great sweet crazy glucklich/d suertud/o fortunat/o veinard/f sacre",
    "THINK": "think thinks believe believes say saying mean want said claim finde glaube meine sage pense crois dis creo digo pienso penso credo dico",
    "META": "speech word/n term/n slur/n insult/n insulting phrase/n name/n expression/n quote/n quoted quotes example/n wort worter begriff ausdruck mot/s terme/s expression/s insulte/s palabra/s insulto/s termino/s parola parole insulti termine slowo слово comment/n message/n leaflet/n poster/n",
    "SUCH": "such as like wie z comme como come that which says said saying sagte dass der die das que reading called the a an is was",
    "CALLED": "called calling calls nannte genannt nennt traite traitait appele qualifie llamo llamaron llamado insulto chiamato chiamo nazwal назвал",
    "SAYS": "says said say claims claimed writes wrote told tells explains explained states reports reported sagt sagte behauptet schreibt dit disait affirme dice dijo escribio afirma ha-detto scrive sostiene",
    "THAT": "that dass que che ze что",
    "MOD": "rule/n forbid/s forbidden forbids moderator/n moderation moderated discuss/v discrimination harassment speech insult/n insulting reminded reported report policy policies quote/n quotes quoted word/n term/n called explain/s explains training train filter/v block/v classifier/n blocked removed banned conduct comment/n list/n blacklist article/n leaflet/n propaganda slur/n abuse offensive stereotype/n prejudice/n racism racist claims hetze regeln verbot sperrliste gesperrt beleidigung moderation discours regle/s interdit/f interdits exclu expulsaron reglas lista prohibid/o discurso prohibidas regole vietat/o elenco",
    "FEEL": "feel felt feeling fuhle sens siento sento",
}
