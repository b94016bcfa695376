"""Questions and the same questions with other numbers, names and units."""

import random

NAMES = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Mallory Nina Oscar Peggy Rupert Sybil Trent Victor Walter Yvonne".split()
PLACES = "Boston Denver Chicago Dallas Houston Phoenix Seattle Portland Atlanta Miami".split()
LENGTHS, WEIGHTS, TIMES = ("km", "miles", "meters"), ("kg", "pounds", "grams"), ("hours", "days", "minutes")
TEMPLATES = (
    "{a} has {n} apples in her basket. {b} gives {m} pears to {a} today. How many fruits does {a} have?",
    "A train leaves {p} at {n} and travels {m} {length} in {k} {time} before it stops at the next station",
    "{a} walks {n} {length} to school every morning and rides {m} {length} home in the evening. What distance does {a} cover in {k} days?",
    "A box of tea weighs {n} {weight} and costs {m} dollars. {a} buys {k} boxes for the shop in {p}. How much does {a} pay?",
    "The sum of {n} and {m} is multiplied by {k} and then divided by the smaller number. What is the result of it?",
    "{a} and {b} share {n} marbles. {a} loses {m} of them on the way. {b} finds {k} more under the old table. Who has more marbles now?",
    "In {p} a worker earns {n} dollars for each of the first {m} {time} and twice as much after that. How much does {a} earn in {k} {time}?",
    "If {n} machines make {m} parts in {k} {time}, how long do twice as many machines need for the same number of parts?",
)


def _filled(template: str, rng: random.Random) -> str:
    a, b = rng.sample(NAMES, 2)
    values = {k: rng.randint(2, 400) for k in "nmk"}
    units = {"length": rng.choice(LENGTHS), "weight": rng.choice(WEIGHTS), "time": rng.choice(TIMES)}
    return template.format(a=a, b=b, p=rng.choice(PLACES), **values, **units)


def parameterised(n: int, seed: int = 4) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(items, texts): item i is a question, text i the question of item i with values drawn anew."""
    rng = random.Random(seed)
    own = [f"{rng.choice('red old small tall quiet'.split())} {rng.choice('boat tower garden bridge market'.split())} number {i}" for i in range(n)]
    asked = [f"{TEMPLATES[i % len(TEMPLATES)]} The story is about the {own[i].rsplit(' ', 2)[0]}." for i in range(n)]
    return [(i, _filled(t, rng)) for i, t in enumerate(asked)], [(i, _filled(t, rng)) for i, t in enumerate(asked)]


#: Values by kind, of one word and of several.
KINDS = {
    "names": ("New York|Paris|San Jose del Cabo|Lima|Cape Town|Rome|Buenos Aires|Oslo|Rio de Janeiro|Quito".split("|"), "Mary Ann Smith|Bob|Jean Luc|Nina|Van der Berg|Tom|Ana Maria Lopez|Ravi".split("|")),
    "number_words": ("twenty one|35|1 200|900|seven hundred thousand|18|forty-two|6|three hundred|77".split("|"),) * 2,
    "measures": ("60cm|80 cm|5 kilometers|12km|seventy miles|3 m|900 meters|14mm".split("|"), "2 hours|45min|thirty minutes|6 h|9 days|120 s|15sec".split("|")),
    "capitals": ("IBM|AMD|NASA|ESA|General Motors|UPS|BBC News|Siemens".split("|"), "USA|France|UK|Peru|New Zealand|UAE".split("|")),
}
#: {a} and {b} are values of the kind, {n} a number.
OF_KINDS = {
    "names": (
        "The old boat leaves the quiet harbour of {a} at {n} and it reaches the next port after {n} hours.",
        "A letter from {b} was found in {a} and nobody there knew which of the {n} drawers it came from.",
        "How far is the river from {a} if {b} walks {n} kilometers along it and then turns back?",
        "When {b} moved to {a} the rent was {n} dollars, how much is paid after it rises by half?",
        "The museum in {a} shows paintings made by {b} and sells {n} tickets on every day of the week.",
        "What does {b} pay for lunch in {a} if each of the dishes costs {n} euros and one is free?",
        "A plane with {n} seats flies to {a} while its captain {b} drinks tea and reads the weather report.",
    ),
    "number_words": (
        "A farmer plants {a} trees in the field and {b} of them die before the rain comes back in spring.",
        "There are {a} books on the shelf, how many are left after {b} of them were sold to the students?",
        "The machine folds {a} sheets, tears {b} of them and throws away half of what is left over then.",
        "Of all the {a} voters in the small town {b} stayed at home because the roads were under snow.",
        "She adds {a} to the sum of {b} and writes the result on the board for the whole class.",
        "If {a} bottles fit in a crate and {b} crates fit on a truck, what does the truck carry?",
        "They counted {a} birds over the lake and later {b} more came from behind the dark hills again.",
    ),
    "measures": (
        "The plank is {a} long and it takes the saw {b} to cut it into pieces of equal size.",
        "A snail crawls {a} along the wall and then rests for {b} before it goes on to the top.",
        "After {b} of heavy rain the water in the tank was {a} above the mark that was painted there.",
        "How many turns does the wheel make over {a} if one turn of it takes exactly {b} on a slope?",
        "The rope was cut to {a} and left in the sun for {b} until all of it was dry again.",
        "Each runner covers {a} before the next one starts, so how far are they apart when {b} have passed?",
        "It takes {b} to paint a fence of {a} so what does the painter ask for both of the sides?",
    ),
    "capitals": (
        "When {a} sells {n} chips to a buyer from {b} for less than they cost, what is the loss?",
        "The office of {a} in the south of {b} employs {n} people and trains a third of them every year.",
        "A report by {a} says that the trade with {b} grew by {n} percent after the tax was lowered again.",
        "Why did {a} move its plant out of {b} when only {n} of the workers had asked for higher wages?",
        "The engineers at {a} built a bridge for {b} that carries {n} cars on each day of the year.",
    ),
    "numbers_only": (
        "{n} + {n} * {n} - {n} / {n} + {n} - {n} = what is it",
        "{n} - {n} - {n} * {n} + {n} / {n} = and now divide by {n}",
        "compute {n} * {n} + {n} * {n} + {n} * {n} - {n} / {n} and round",
        "{n} / {n} + {n} / {n} + {n} / {n} - {n} / {n} = give the answer",
    ),
}


def _by_kind(kind: str, template: str, rng: random.Random) -> str:
    places, people = KINDS.get(kind, ((), ()))
    a = rng.choice(places or [""])
    # two values that differ, as one value of an item can't become two
    text = template.replace("{a}", a).replace("{b}", rng.choice([x for x in people if x != a] or [""]))
    while "{n}" in text:
        text = text.replace("{n}", str(rng.randint(2, 900)), 1)
    return text


def of_kinds(each: int = 10, seed: int = 5) -> list[tuple[str, str, str]]:
    """(kind, question, the question with values drawn anew): ``each`` for each of thirty templates."""
    rng = random.Random(seed)
    return [(kind, _by_kind(kind, t, rng), _by_kind(kind, t, rng)) for kind, templates in OF_KINDS.items() for t in templates for _ in range(each)]
