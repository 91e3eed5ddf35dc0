"""Word lists of the labelers that look for personal data."""

# Common given names of many countries, in lower case.
GIVEN_NAMES = """
aaron adam adrian adriana agnes agnieszka ahmed aisha alan alberto alejandro alex alexander ali alice amina amir amira amy ana
andrea andrew andrzej angela anita anna anne antonio arjun arthur astrid barbara beatriz ben bianca björn boris brian bruno
camille carla carlos carmen caroline catherine charles chen chiara chidi chloe chris christian clara claire claudia
daniel david deepa diana diego dmitri dmitry edward elena elias elif elizabeth emil emily emma eric erik esther eva fatima felix fernando
francesca francisco gabriel george giulia greta hana hannah hans hassan heidi helen helena henry hiroshi hugo håkon ibrahim igor ines ingrid irene
isabel ivan jack jakub james jan jana jane javier jean jennifer joana johan john jonas jorge josé juan judith julia julie jürgen
kai karen karin karl katarzyna kate katya kenji kevin khalid kofi lars laura leila lena leo lin linda linh lisa louis lucas lucía lukas
marco maria marie mario mark marta martin mary mateo mei michael mohammed nadia ngozi nina nora olga oliver omar oscar
pablo patricia paul paula pedro peter philip pierre piotr priya rachel rafael raj ravi rebecca rené ricardo robert rosa
samuel sandra sara sebastian simon sofia stefan søren susan sven tanja teresa thabo thomas tomas victor wei william yuki yusuf zoë
""".split()

# Small words that stand within family names.
PARTICLES = "van von vom zu de da das del della der den di do dos du la le el al bin ben ten ter y san st mac mc o".split()

# Words of everyday text that are no family name, in lower case.
COMMON_WORDS = """
a about after again all also always am an and any are as ask at avant avec be because been before but by can could
das dat de dem den der des did die do does don done du during ein eine el en est et everyone for from had has have he her
here him his how i if in into is ist it its last le les like lives los made mail may me means meeting met mit more most moved my
near next nicht no not notes now of off on one only or our out over owner para pas por prefers que quick record reply s
said says say she should signed since so some still such than that the their them then there these they this those thought to today
tomorrow too und under une up us user very was we went were what when where which who whose why will with without would yes
yesterday you your project release session form birthday allergic number phone street road dot at and'
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
""".split()

# Titles that stand before a name.
TITLES = "dr mr mrs ms miss prof professor sir herr frau sr sra señor señora mme monsieur madame doctor".split()
