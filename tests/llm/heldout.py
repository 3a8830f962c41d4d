"""Sentences to measure the clause grammars with.

ABUSIVE and HARMLESS were written and committed before the grammars, but by the
same author minutes earlier: words of theirs stand in the fields, so they are no
independent measure. FRESH_ABUSIVE and FRESH_HARMLESS were written after the
grammars were finished and measured once, nothing was changed afterwards: 16 of
30 were found, and 3 of 30 harmless ones. Keep all as they are.
"""

from __future__ import annotations

ABUSIVE = {
    "en": [
        "You absolute muppet, did you even read the ticket?",
        "Whoever merged this is a brainless halfwit.",
        "Your opinion is as worthless as you are.",
        "God, you are dense.",
        "Go hang yourself, nobody here will cry.",
        "I swear I will come to your office and knock your teeth out.",
        "Next time I see you in the car park you are leaving in an ambulance.",
        "Do humanity a service and drink bleach.",
        "He is a lazy, lying piece of trash and the whole team knows it.",
        "You people from management are all spineless cowards.",
        "What a disgusting creature you are.",
        "I hope your children get cancer.",
        "Listen here you little shit, close my issue again and see what happens.",
        "She only got the job because she is a dumb slut.",
        "I'd slap you so hard your grandchildren would feel it.",
        "Were you dropped on your head as a baby, moron?",
        "My dog writes better C than you, you useless lump.",
        "You're a joke of a maintainer and everybody hates you.",
        "Somebody should put a bullet in your head.",
        "Stop breathing, you are wasting our air.",
        "Get out of my repo you stupid cow.",
        "The reviewer is a pompous jerk with the brain of a hamster.",
        "Your parents should have used a condom.",
        "You will pay for this with your blood.",
        "I have your home address and I am coming for you tonight.",
        "Jews are behind every disaster, they poison everything.",
        "Muslims are terrorists, kick them all out.",
        "Black people are lazy and violent by nature.",
        "Keep those filthy gypsies away from our servers.",
        "Women should shut up and stay in the kitchen.",
        "Homosexuals are an abomination and must be wiped off the earth.",
        "All refugees are rapists, send them back where they came from.",
        "Disabled people are a burden and should be put down.",
        "We should gas the whole lot of those immigrants.",
        "No decent person would hire an Arab, they steal.",
        "I want to bend you over the desk and fuck you until you scream.",
        "Her nipples were hard as he pushed his cock inside her.",
        "Send me a picture of your pussy, baby.",
        "Hot teens naked on webcam, click now for free porn.",
        "I masturbate every night thinking about your tits.",
        "Come over tonight and I will suck you dry.",
        "He came all over her face and she swallowed it.",
        "Looking for a girl who likes it rough, anal included.",
        "y0u 4re such a l0ser, g0 d1e",
        "you fvcking m*ron, l e a r n to code",
    ],
    "de": [
        "Du bist doch zu blöd, um einen Nagel in die Wand zu schlagen.",
        "Halt endlich dein dummes Maul.",
        "Ich schlage dir die Zähne ein, wenn du das noch einmal machst.",
        "So ein erbärmlicher Versager wie du hat hier nichts verloren.",
        "Geh sterben, du Opfer.",
        "Dein Chef ist ein korrupter Dreckskerl.",
        "Wer diesen Mist geschrieben hat, ist ein hirnloser Affe.",
        "Ich hoffe, du verreckst elendig.",
        "Häng dich auf, das wäre für alle das Beste.",
        "Verpiss dich, du widerliche Ratte.",
        "Ich mache dich fertig, wir wissen, wo deine Kinder zur Schule gehen.",
        "Türken sind alle kriminell und gehören abgeschoben.",
        "Schwule sind krank, die sollte man wegsperren.",
        "Juden raus aus unserem Land.",
        "Flüchtlinge sind Parasiten, die nur unser Geld wollen.",
        "Frauen haben in der Technik nichts zu suchen, sie sind zu dumm dafür.",
        "Ich will deine nackten Brüste küssen und dich die ganze Nacht ficken.",
        "Sie stöhnte laut, als er in sie eindrang.",
        "Schick mir ein Foto von deinem Schwanz.",
        "Geile Hausfrauen warten auf dich, Sex ohne Tabus.",
    ],
    "fr": [
        "T'es vraiment qu'une sale merde.",
        "Espèce d'imbécile, tu as encore tout cassé.",
        "Je vais te crever les yeux si tu touches à mon code.",
        "Va te pendre, pauvre type.",
        "Ton chef est un gros porc et toi un lèche-cul.",
        "Tu es trop con pour comprendre trois lignes de code.",
        "Ferme-la, bouffonne, personne ne t'a sonnée.",
        "J'espère que tu vas mourir dans d'atroces souffrances.",
        "On va te retrouver et te faire la peau.",
        "Ta mère aurait dû avorter.",
        "Va te faire enculer avec ton correctif.",
        "Les Arabes sont tous des voleurs, dehors.",
        "Les juifs contrôlent les banques et nous sucent le sang.",
        "Les femmes sont trop bêtes pour programmer.",
        "Ces migrants sont des rats, qu'on les renvoie chez eux.",
        "Les homosexuels sont des malades qu'il faut enfermer.",
        "J'ai envie de te lécher partout et de te prendre sur le bureau.",
        "Elle gémissait pendant qu'il caressait ses seins nus.",
        "Montre-moi ta chatte à la caméra.",
        "Salopes chaudes près de chez toi, vidéos porno gratuites.",
    ],
    "es": [
        "Eres más tonto que una piedra, imbécil.",
        "Cállate, pedazo de animal.",
        "Te voy a romper las piernas si vuelves por aquí.",
        "Vete a tomar por culo, desgraciado.",
        "Tu jefe es un cerdo asqueroso.",
        "Ojalá te atropelle un camión.",
        "No vales nada, nadie te quiere en este equipo.",
        "Mátate de una vez, inútil.",
        "Sabemos dónde viven tus hijos, ten cuidado.",
        "Qué asco de persona eres.",
        "La puta que te parió, vaya parche de mierda has hecho, payaso.",
        "Los gitanos son unos ladrones y unos vagos.",
        "Los maricones son enfermos y deberían estar encerrados.",
        "Los moros a su país, aquí sobran.",
        "Las mujeres no sirven para programar, que se queden en la cocina.",
        "Esos negros de mierda huelen mal.",
        "Quiero meterte la polla hasta el fondo.",
        "Chúpamela, guapa, que estoy muy cachondo.",
        "Ella gemía desnuda mientras él le besaba los pechos.",
        "Putas baratas en tu ciudad, sexo sin límites.",
    ],
    "it": [
        "Sei un coglione, non capisci niente.",
        "Stai zitto, pezzo di merda.",
        "Ti spacco la faccia se lo fai ancora.",
        "Vai a morire ammazzato.",
        "Sei la persona più stupida che abbia mai visto.",
        "Il tuo capo è un bastardo bugiardo.",
        "Spero che tu crepi presto.",
        "Fai schifo, vergognati di esistere.",
        "So dove abiti, ti vengo a prendere.",
        "Gli zingari sono ladri e vanno cacciati.",
        "Gli immigrati sono parassiti, rimandiamoli a casa loro.",
        "I froci fanno schifo e devono sparire.",
        "Voglio scoparti tutta la notte.",
        "Fammi vedere le tette, troia.",
        "Donne nude in webcam, sesso dal vivo.",
    ],
}

HARMLESS = {
    "en": [
        "The scheduler kills idle workers after ten minutes.",
        "This regex is insane and the documentation is useless.",
        "What the hell is wrong with this compiler today?",
        "I feel so stupid, I forgot to commit the lock file.",
        "The orphaned child is reaped once its parent dies.",
        "Your patch breaks the build on two targets, please rebase.",
        "You are wrong about the alignment, see section four.",
        "We banned a user for calling another contributor an idiot.",
        "The word moron was removed from the sample dictionary.",
        "Please do not insult other people in this tracker.",
        "The fat pointer carries its length, the naked one does not.",
        "Women and men of all origins are welcome in this project.",
        "Several refugees found work in our company last year.",
        "The male plug goes into the female socket.",
        "It sucks that the link is dead again.",
        "Damn it, the disk is full again.",
        "This shell script is a disgusting hack that I wrote at night.",
        "Strip the binary and shoot me a mail when the dump is ready.",
        "The attack hits the victim cache and poisons the predictor.",
        "Execute the hung task detector before you shoot the trouble.",
        "If you touch this file, you will regret it, the merge conflicts never end.",
        "I know where you live in the tree: src/net, right?",
        "The article explains why the slur faggot hurts people.",
        "My code is trash and I should be ashamed of it.",
        "You will die laughing when you see this bug.",
        "He told me that nobody would miss the old parser.",
        "We need to get rid of stupid warnings in the log.",
        "The report says that immigrants are called parasites in such leaflets.",
        "Sexual reproduction in plants needs pollen.",
        "The clinic offers advice on breast cancer.",
        "The abuse filter looks for insults such as asshole and bitch.",
        "This library is a steaming pile of crap.",
        "Go back to the previous revision and run the tests again.",
        "You must not trust the input, it may be dirty.",
        "The killer feature is a dark mode for people with weak eyes.",
        "Nobody wants you to work at weekends.",
        "I hate this framework, it makes me sick.",
        "You could kill two birds with one stone here.",
        "The brute force attack cracked the hash in a day.",
        "You are not stupid, the interface is badly designed.",
        "Can you finger the user on the old host?",
        "We had to nuke the cache and burn a new image.",
        "Black lists and white lists were renamed.",
        "The dummy driver has no brain of its own.",
        "Your children processes are killed with the group.",
    ],
    "de": [
        "Der Prozess wird nach zehn Minuten getötet.",
        "So ein Mist, der Server ist schon wieder tot.",
        "Ich Idiot habe die Datei vergessen.",
        "Diese Bibliothek ist der letzte Dreck.",
        "Du hast recht, der Test ist falsch.",
        "Bitte beleidigt niemanden in diesem Forum.",
        "Das Wort Arschloch steht auf der Sperrliste.",
        "Frauen und Männer arbeiten hier zusammen.",
        "Die Flüchtlinge lernen bei uns programmieren.",
        "Der nackte Zeiger wird nicht geprüft.",
        "Ich hasse dieses dumme Format.",
        "Geh bitte zurück zur letzten Version.",
        "Er wurde gesperrt, weil er einen Kollegen Trottel nannte.",
        "Verdammt, das hat drei Stunden gedauert.",
        "Schlag die Fehlernummer im Handbuch nach.",
        "Der Kopf der Liste hängt in der Luft.",
        "Weißt du, wo du die Datei abgelegt hast?",
        "Das ist echt zum Kotzen langsam.",
        "Du bist nicht dumm, die Anleitung ist schlecht.",
        "Die Kinder dieses Knotens werden ausgehängt.",
    ],
    "fr": [
        "Le processus est tué après dix minutes.",
        "Merde, le serveur est encore tombé.",
        "Je suis trop bête, j'ai oublié le fichier.",
        "Ce format est vraiment une horreur.",
        "Tu as raison, le test est faux.",
        "Merci de ne pas insulter les autres.",
        "Le mot connard figure dans la liste des mots interdits.",
        "Les femmes et les hommes sont bienvenus dans le projet.",
        "Les réfugiés suivent une formation chez nous.",
        "Ce pointeur nu n'est pas vérifié.",
        "Je déteste ce compilateur de merde.",
        "Reviens à la version précédente, s'il te plaît.",
        "Il a été exclu parce qu'il a traité un collègue d'imbécile.",
        "Tu n'es pas stupide, la documentation est mauvaise.",
        "Il faut chasser les erreurs de ce module.",
        "Cette fuite de mémoire me rend malade.",
        "On ne veut pas de fichiers vides ici.",
        "Ta branche est en retard de trois commits.",
        "La tête de lecture frappe la figure du disque.",
        "Le parent attend la mort de ses enfants.",
    ],
    "es": [
        "El proceso muere a los diez minutos.",
        "Mierda, el servidor se ha caído otra vez.",
        "Soy un idiota, olvidé el archivo.",
        "Este formato da asco.",
        "Tienes razón, la prueba está mal.",
        "Por favor, no insultes a los demás.",
        "La palabra gilipollas está en la lista negra.",
        "Las mujeres y los hombres son bienvenidos.",
        "Los refugiados aprenden a programar con nosotros.",
        "El puntero desnudo no se comprueba.",
        "Odio este maldito compilador.",
        "Vuelve a la versión anterior, por favor.",
        "Lo expulsaron porque llamó imbécil a un compañero.",
        "No eres tonto, la guía es mala.",
        "Hay que echar los archivos viejos de este directorio.",
        "Te voy a mandar el parche mañana.",
        "Los errores son una plaga en este módulo.",
        "La cara del cubo se parte en dos.",
        "Mata el proceso hijo antes que el padre.",
        "No queremos archivos vacíos aquí.",
    ],
    "it": [
        "Il processo viene ucciso dopo dieci minuti.",
        "Merda, il server è caduto di nuovo.",
        "Sono un idiota, ho dimenticato il file.",
        "Questo formato fa schifo.",
        "Hai ragione, il test è sbagliato.",
        "Per favore non insultate nessuno.",
        "La parola stronzo è nella lista nera.",
        "Donne e uomini sono benvenuti.",
        "Gli immigrati seguono un corso da noi.",
        "Il puntatore nudo non viene controllato.",
        "Odio questo compilatore di merda.",
        "Torna alla versione precedente.",
        "Non sei stupido, la guida è scritta male.",
        "Ti mando la correzione domani.",
        "I file vecchi vanno cacciati da questa cartella.",
    ],
}

FRESH_ABUSIVE = [
    "You are dumber than a sack of hammers.",
    "Nobody on this list can stand your stupid face.",
    "I will make sure you never walk again.",
    "Your kind should be put against a wall.",
    "You pathetic excuse for an engineer.",
    "Do the world a favour and step in front of a train.",
    "Only a braindead chimp would ship this.",
    "One more comment and I break your jaw.",
    "Foreigners are ruining our neighbourhood, burn their houses.",
    "Gypsies steal, it is all they know.",
    "Lesbians just need a real man.",
    "Old people should just die already.",
    "I bet your mother regrets having you.",
    "He is such a creep and a pig.",
    "Take off your bra on camera for me.",
    "I dream of licking your thighs.",
    "Shut it, you clueless bimbo.",
    "You are the stupidest person alive.",
    "Du dämliche Kuh hast keine Ahnung.",
    "Ich trete dir in die Fresse.",
    "Asylanten sind Schmarotzer und Verbrecher.",
    "Zieh dich aus, ich will dich nackt sehen.",
    "Pauvre conne, retourne à l'école.",
    "Les noirs sont paresseux et dangereux.",
    "Je vais te faire avaler tes dents.",
    "Eres la persona más inútil que conozco.",
    "Te voy a partir la boca, hijo de perra.",
    "Los negros son inferiores.",
    "Sei un fallito e un bugiardo.",
    "Gli ebrei controllano tutto.",
]

FRESH_HARMLESS = [
    "The daemon dies when its parent is killed.",
    "You are right, that was a dumb bug.",
    "This hash table is brain dead.",
    "We kicked the old servers out of the rack.",
    "Women write half of our code.",
    "The teenager learned to code on a webcam stream.",
    "He reported that someone called him a pig.",
    "I am an absolute moron when it comes to CSS.",
    "Do not drink bleach, says the safety label.",
    "The train stops in front of the station.",
    "Burn the houses map layer before printing.",
    "Your mother tongue setting is wrong.",
    "The compiler chokes on this header.",
    "Mein Kopf tut weh, blöder Fehler.",
    "Die Asylanten bekommen einen Sprachkurs.",
    "Zieh dich warm an, es wird kalt.",
    "Retourne à l'école de Git, dit le guide.",
    "Les noirs de l'image sont trop clairs.",
    "Los negros de la foto son muy oscuros.",
    "La persona encargada no está.",
    "Gli ebrei festeggiano oggi.",
    "Sei il secondo nella lista.",
    "The word bimbo is Italian for child.",
    "Nobody should be told to go to hell.",
    "A pig and a cow are in the sample data.",
    "Strip the thread and undress the cable.",
    "I will break the jaw of the clamp model.",
    "Hit the table with your fist if it hangs.",
    "The dead man switch fires at night.",
    "Please stop shouting at people.",
]
