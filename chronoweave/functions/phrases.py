"""Phrases for relations.

Fixed values: how a relation is said in the past tense, irregular pasts, and the
prepositions after which no other is added.
"""

PHRASES = {
    "make statement": "made a statement about",
    "make a statement": "made a statement about",
    "make optimistic comment": "made an optimistic comment about",
    "make pessimistic comment": "made a pessimistic comment about",
    "make empathetic comment": "made an empathetic comment about",
    "discuss by telephone": "discussed by telephone with",
    "visit": "made a visit to",
    "make a visit": "made a visit to",
    "host a visit": "hosted a visit by",
    "meet": "met",
    "consult": "consulted with",
    "negotiate": "negotiated with",
    "engage in negotiation": "engaged in negotiation with",
    "engage in diplomatic cooperation": "engaged in diplomatic cooperation with",
    "engage in material cooperation": "engaged in material cooperation with",
    "cooperate": "cooperated with",
    "cooperate militarily": "cooperated militarily with",
    "cooperate economically": "cooperated economically with",
    "sign agreement": "signed an agreement with",
    "sign formal agreement": "signed a formal agreement with",
    "appeal": "made an appeal to",
    "make an appeal": "made an appeal to",
    "make an appeal or request": "made an appeal or request to",
    "appeal for diplomatic cooperation (such as policy support)": "appealed for diplomatic cooperation with",
    "appeal for economic cooperation": "appealed for economic cooperation with",
    "appeal for military cooperation": "appealed for military cooperation with",
    "express intent to cooperate": "expressed intent to cooperate with",
    "express intent to cooperate economically": "expressed intent to cooperate economically with",
    "express intent to meet or negotiate": "expressed intent to meet or negotiate with",
    "express intent to engage in diplomatic cooperation (such as policy support)": "expressed intent to engage in diplomatic cooperation with",
    "express intent to provide aid": "expressed intent to provide aid to",
    "express intent to provide material aid": "expressed intent to provide material aid to",
    "express intent to provide military aid": "expressed intent to provide military aid to",
    "express intent to allow international involvement (non-mediation)": "expressed intent to allow international involvement regarding",
    "express intent to change leadership": "expressed intent to change leadership of",
    "express intent to settle dispute": "expressed intent to settle a dispute with",
    "express intent to change institutions, regime": "expressed intent to change institutions or regime of",
    "express intent to yield": "expressed intent to yield to",
    "praise or endorse": "praised or endorsed",
    "rally support on behalf of": "rallied support on behalf of",
    "grant diplomatic recognition": "granted diplomatic recognition to",
    "provide aid": "provided aid to",
    "provide humanitarian aid": "provided humanitarian aid to",
    "provide military aid": "provided military aid to",
    "provide economic aid": "provided economic aid to",
    "provide material aid": "provided material aid to",
    "yield": "yielded to",
    "accede to demands for rights": "acceded to demands for rights of",
    "ease administrative sanctions": "eased administrative sanctions on",
    "return, release person(s)": "returned or released person(s) held by",
    "return, release": "returned or released",
    "criticize": "criticized",
    "criticize or denounce": "criticized or denounced",
    "condemn": "condemned",
    "accuse": "accused",
    "accuse of war crimes": "accused of war crimes",
    "deny": "denied responsibility to",
    "deny responsibility": "denied responsibility to",
    "reject": "rejected",
    "demand": "made a demand of",
    "threaten": "threatened",
    "threaten with military force": "threatened with military force against",
    "threaten with political sanctions, not specified below": "threatened with political sanctions against",
    "threaten with administrative sanctions": "threatened with administrative sanctions against",
    "protest": "protested against",
    "demonstrate or rally": "demonstrated or rallied against",
    "demonstrate, rally for": "demonstrated or rallied for",
    "protest violently, riot": "protested violently or rioted against",
    "obstruct passage, block": "obstructed passage or blocked",
    "engage in mass killings": "engaged in mass killings against",
    "engage in mass expulsion": "engaged in mass expulsion of",
    "sanction": "imposed sanctions on",
    "impose embargo, boycott, or sanctions": "imposed an embargo, boycott, or sanctions on",
    "impose administrative sanctions": "imposed administrative sanctions on",
    "reduce or break diplomatic relations": "reduced or broke diplomatic relations with",
    "reduce relations": "reduced relations with",
    "halt negotiations": "halted negotiations with",
    "expel or withdraw": "expelled or withdrew",
    "expel or withdraw peacekeepers": "expelled or withdrew peacekeepers from",
    "confiscate property": "confiscated property of",
    "investigate": "investigated",
    "investigate crime, corruption": "investigated crime or corruption involving",
    "arrest, detain, or charge with legal action": "arrested, detained, or charged with legal action",
    "arrest": "arrested",
    "fight": "fought with",
    "assault": "assaulted",
    "physically assault": "physically assaulted",
    "fight with small arms and light weapons": "fought with small arms and light weapons against",
    "use conventional military force": "used conventional military force against",
    "use unconventional military force": "used unconventional military force against",
    "use unconventional violence": "used unconventional violence against",
    "use chemical, biological, or radiological weapons": "used chemical, biological, or radiological weapons against",
    "conduct suicide, car, or other non-military bombing": "conducted a suicide, car, or other non-military bombing against",
    "abduct, hijack, or take hostage": "abducted, hijacked, or took hostage",
    "coerce": "coerced",
    "mobilize": "mobilized against",
    "at war": "was at war with",
    "engage in symbolic act": "engaged in a symbolic act with",
    "engage in unconventional mass violence": "engaged in unconventional mass violence against",
    "occupy territory": "occupied territory of",
    "seize or damage property": "seized or damaged property of",
    "use as human shield": "used as human shield",
    "assassinate": "assassinated",
    "attempt to assassinate": "attempted to assassinate",
    "sexually assault": "sexually assaulted",
    "torture": "tortured",
    "kill by physical assault": "killed by physical assault",
}

IRREGULAR = {
    "meet": "met",
    "fight": "fought",
    "make": "made",
    "is": "was",
    "have": "had",
    "go": "went",
    "give": "gave",
    "take": "took",
    "get": "got",
    "say": "said",
    "see": "saw",
    "know": "knew",
    "come": "came",
    "find": "found",
    "think": "thought",
    "tell": "told",
    "begin": "began",
    "run": "ran",
    "write": "wrote",
    "bring": "brought",
    "buy": "bought",
    "send": "sent",
    "build": "built",
    "cut": "cut",
    "put": "put",
    "set": "set",
    "hit": "hit",
    "let": "let",
    "hold": "held",
    "read": "read",
    "stand": "stood",
    "win": "won",
    "break": "broke",
    "drive": "drove",
    "keep": "kept",
    "lead": "led",
    "lose": "lost",
    "pay": "paid",
    "rise": "rose",
    "speak": "spoke",
    "steal": "stole",
    "throw": "threw",
    "withdraw": "withdrew",
}

PREPOSITIONS = ("to", "with", "for", "by", "from", "on", "about", "against", "of", "in")
