"""Fixed word lists for names: nicknames, titles, and the words of institutions with their abbreviations."""

from __future__ import annotations

# fixed values: short and pet forms of given names, each with the name it stands for
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "tony": "antonio", "toni": "antonio", "ben": "benjamin", "benny": "benjamin",
    "kathy": "katherine", "kate": "katherine", "katie": "katherine", "cathy": "katherine", "charlie": "charles", "chuck": "charles", "chris": "christopher",
    "dani": "daniela", "dan": "daniel", "danny": "daniel", "dave": "david", "lola": "dolores", "ed": "edward", "ned": "edward", "ted": "edward", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "curro": "francisco", "frank": "francis", "fred": "frederick", "gabi": "gabriela", "gaby": "gabriela", "beppe": "giuseppe", "peppe": "giuseppe",
    "harry": "henry", "hank": "henry", "nacho": "ignacio", "jack": "john", "hannes": "johannes", "hans": "johannes", "pepe": "jose", "jim": "james", "jimmy": "james", "joe": "joseph", "leo": "leonardo",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "mari": "maria", "mike": "michael", "mick": "michael", "misha": "mikhail", "matt": "matthew",
    "kolya": "nikolai", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "pete": "peter", "phil": "philip", "bob": "robert", "rob": "robert", "bobby": "robert", "dick": "richard", "rick": "richard", "roz": "rosalind", "ron": "ronald",
    "sam": "samuel", "steve": "stephen", "sue": "susan", "dora": "theodora", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "uli": "ulrich", "vicky": "victoria", "vicki": "victoria", "bill": "william", "will": "william", "billy": "william", "volodya": "vladimir",
    "zach": "zacharias", "zack": "zacharias", "katya": "ekaterina", "natasha": "natalia", "tanya": "tatiana", "anya": "anna", "nancy": "anne", "chema": "jose", "quique": "enrique", "heinz": "heinrich", "fritz": "friedrich", "moni": "monika", "gigi": "luigi", "mimmo": "domenico",
}

# fixed values: titles before names
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "sir", "dame", "dott", "herr", "frau", "ing"}

# fixed values: words of institutions, with the abbreviations and translations that stand for them
INSTITUTION_WORDS = {
    "institute": ("inst", "instit", "instituto", "institut", "istituto"), "department": ("dept", "dep", "departamento", "departement", "dipartimento", "abteilung"), "centre": ("center", "ctr", "centro", "zentrum"),
    "laboratory": ("lab", "labs", "laboratorio", "laboratoire", "laboratories", "labor"), "unit": ("unidad", "unidade", "unite"), "division": ("div", "division"), "faculty": ("facultad", "faculdade", "fakultat"), "school": ("sch", "escuela", "escola"),
    "facility": ("fac", "facilities"), "core": (), "service": ("servicio", "services"), "section": ("sect", "seccion"), "group": ("grp", "grupo"), "clinic": ("clin", "clinica"),
    "virology": ("virol", "virologia", "virologie"), "microbiology": ("microbiol", "microbiologia", "mikrobiologie", "microbiologie"), "epidemiology": ("epidemiol", "epidemiologia", "epidemiologie"), "genomics": ("genom", "genomica", "genomik"), "arboviruses": ("arbovirus", "arbovir"),
    "medicine": ("med", "medicina", "medizin", "medical"), "tropical": ("trop", "tropenmedizin"), "public": ("publ", "publica", "publique", "pub"), "health": ("hlth", "salud", "saude", "sante"), "infectious": ("infect", "infecciosas"), "diseases": ("dis", "enfermedades", "disease"),
    "biology": ("biol", "biologia"), "science": ("sci", "sciences", "ciencias"), "molecular": ("mol",), "genetics": ("genet", "genetica"), "immunology": ("immunol", "inmunologia"), "pathology": ("pathol", "patologia"), "veterinary": ("vet", "veterinaria"), "research": ("res", "investigacion"), "control": (), "prevention": ("prev",), "surveillance": ("surv", "vigilancia"), "sequencing": ("seq", "secuenciacion"), "network": ("netw", "red"),
    "university": ("univ", "universidad", "universidade", "universitat", "universite", "universita"), "academy": ("acad", "academia", "akademie", "academie"), "national": ("natl", "nat", "nacional", "nationale"), "college": ("coll", "colegio"), "technical": ("tech", "tecnico", "technological"), "hospital": ("hosp", "hopital"), "general": ("gen",), "ministry": ("min", "ministerio"), "foundation": ("found", "fundacion"),
}

#: words that say what kind of body a unit belongs to
BODY_WORDS = {"university", "academy", "national", "college", "technical", "hospital", "general", "ministry", "foundation"}
# fixed values: one unit under two names, as sets of words
SAME_UNITS = (({"unit", "genomics"}, {"genomics", "core", "facility"}),)
# fixed values: words without weight in names of institutions
FILLERS = {"of", "and", "for", "the", "de", "y", "la", "del", "el", "da", "do", "e", "et", "und", "fur", "at", "in"}
# fixed values: words before a number that name a part of a building
BUILDING_PARTS = {"block", "unit", "annex", "building", "room", "floor", "suite", "wing"}
