"""Short forms of given names, a table handed to problem 7 by its query; any other (short, full) table will do."""

#: Full form: short forms (fixed values).
SHORT_FORMS = """
alexander: alex al sasha sandy xander
andrew: andy drew
anneliese: anni anne anna liesl lise
anthony: tony
amara: mara ama
bartholomew: bart barty
benjamin: ben benny
chukwuemeka: emeka chuks
christopher: chris
cornelia: nelly nela conny connie cora
daniel: dan danny
david: dave
dorothea: dora dot dorle thea dotty
eduardo: edu eddie lalo ed
elizabeth: liz beth lisa betty eliza libby
francisco: paco pancho fran cisco
frederick: fred freddy fritz rick
gabriela: gabi gaby gabby
henrietta: hetty etta henni
ignatius: iggy nacho ignaz
james: jim jimmy
johannes: hannes hans
john: jack johnny
joseph: joe
josephine: josie josy fina
katherine: kate kathy katie kat
kenji: ken
leopold: leo poldi
leszek: lech leszko
margaret: maggie meg peggy greta marge
matthew: matt
maximilian: max maxi
michael: mike mick
nicholas: nick nico nicky klaus
ottokar: otto
priyanka: priya pri
robert: rob bob bobby robbie
rosalind: roz ros rosie
samuel: sam
sebastian: seb basti bastian
stephen: steve
tatjana: tanja tanya tania
theodore: theo ted teddy
thomas: tom tommy
ulrike: uli ulli rike
valentina: val vally tina
victoria: vicky vic tori vicki
william: will bill billy liam willy
yolanda: yoli yola landa
zacharias: zack zach zac
"""

#: Words for a group of people (fixed values).
SYNONYMS = {"team": "squad", "crew": "squad", "sqd": "squad"}


def short_forms() -> list[tuple[str, str]]:
    """(short, full) rows."""
    lines = (line.split(":") for line in SHORT_FORMS.strip().splitlines())
    return [(short, full) for full, shorts in lines for short in shorts.split()]
