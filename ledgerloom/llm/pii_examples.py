"""The small labelled table from which the tagger is trained.

A row is a sentence, or a few, with typed slots.  Sentences are made from frames of
everyday correspondence; words, places, firms and surnames are random syllables of
no particular language, and first names are common ones of many countries.  All is
drawn by a seeded generator, so the table is the same everywhere.  Every frame has
a number; a share of the frames can be kept out of training to measure on them.
"""

from __future__ import annotations

import random
import re

SLOTS = {"name": "person_name", "first": "person_name", "turned": "person_name", "initial": "person_name", "upper": "person_name", "lower": "person_name", "email": "email", "hidden": "email", "phone": "phone", "id": "national_id", "passport": "national_id", "address": "address"}

#: Frames that hold personal data, and frames that look alike but hold none.
FRAMES = """
Dear {title} {name},
Dear {name},
Dear {first},
Dear {title} {initial},
Good morning {first},
Good evening {title} {name},
Hello {name},
Hello {first}
Hello {first}!
hello {first},
Hey {first}!
hey {first}
Hi {first},
Hi {first}
hi {first}
Hi {first}, {thing} {num} is {state}.
Welcome back, {first}!
Many thanks, {first}!
{first}, your {thing} is {state}.
Guten Tag {title} {name},
Bonjour {first},
Greetings {first}, we have news about your {thing}.
Yours sincerely, {name}
Yours faithfully, {initial}
With best regards, {name} ({role})
Kind greetings, {name}, {role}
Kind greetings, {name}, room {num}
Cheers, {first}
Thanks, {name}
All the best, {first}
{name}
{name}, {role}
{name} - {firm}
{upper}
{upper} / {placeupper} {code}
{upper} – {placeupper} no {num}
{upper}, {placeupper}, {num}
ATTN {upper}
attn {lower}, {thing} {num}
Attention: {name}
The {thing} was {done} by {name} on {weekday}.
The {thing} was {done} by {first} at our {place} {premises}.
The {thing} was {done} by {initial} near gate {num}.
Your visit was {done} by {first} in {place}.
{done} by {lower}, mobile {phone}
{done} for {name}, mobile {phone}
Left with {name} at door {num}.
Left with {lower} next door tel {phone}
Please ask {name} for the {thing}.
Please ask for {first} when you ring {phone}.
You can reach {name} on {phone}, {weekday} only.
{weekday} {name} <{email}> told us that the {thing} is {state}.
Last {weekday} {name} <{email}> said the {thing} came late.
{name} ({email}) asked about the {thing}.
From: {name} <{email}>
{name} <{email}>
"{name}" <{email}>
"{turned}" <{email}>
{turned} <{email}>
{turned} <{email}>
"{turned}" <{email}>
"{turned}" ({email})
<{email}>
{email}
{email}, {email}
cc {email};{email}
A copy of the {doc} was sent to {email}.
A copy of the {doc} was sent to {hidden} today.
Questions? Mail {email} or phone {phone}.
Questions go to {hidden}.
Answer at {hidden} before {weekday}.
We wrote to you under {email} (twice).
We wrote to you under {hidden} (twice).
Holder {name}, {thing} no {num}.
Holder {initial}, {thing} no {num}.
Name on the card: {name}, ending {d4}.
Name on the card {initial}, valid to {d2}/{d2}.
Booked for {name} and {name}, {weekday}.
Booked under {turned} for {weekday}.
Account of {turned}, address {address}.
Account of {name}, sent to {address}
We list {turned} as the payer, living at {address}.
Send the {thing} to {name}, {address}
Send the {thing} to: {address}.
Ship to: {name}, {address}
Bill to {name}, {address}
Bring the {thing} to {address} and call {phone} first.
Drop-off is now {address}, not {address}.
The flat at {address} gets a new {thing}.
Work at {address} starts on {weekday}.
We moved to {address}. Our {thing} stays the same.
Home address: {address}
{address}
Call {phone} for {thing} matters.
Call {phone} or {phone}.
Tel {phone}
tel. {phone}, fax {phone}
Phone: {phone}
My number is {phone}, the old one was {phone}, say {first}
Text {phone} if the {thing} is {state}.
Mobile {phone}, mail {email}.
We have {id} as the national insurance number of {name}.
Insurance number {id} belongs to {name}.
NI number: {id}
NI number {id} on the form. Please check it.
The identity number {id} was read from the form of {name}.
Your passport {passport} expires soon.
Passport no. {passport} was seen by {name}.
Passport: {passport}
The passport number {passport} was noted.
Passport number {passport} was read.
SSN {id}
SSN on record: {id}. Thank you.
Visitor {name}, passport or identity card {passport}, mail {email}
Visitor {name}, passport or identity card {id}, mail {email}
Visitor: {name}, mail {email}
Visitor: {initial}, phone {phone}
The social security number {id} is missing a page.
Form signed: {name}, {id}
{nlead} {name}{ntail}
{nlead} {name}{ntail}
{nlead} {name}{ntail}
{nlead} {name}{ntail}
{nlead} {first}{ntail}
{nlead} {first}{ntail}
{nlead} {initial}{ntail}
{nlead} {title} {name}{ntail}
{nlead} {turned}{ntail}
{nlead} {upper}{ntail}
{nlead} {lower}{ntail}
{nlead} {lower}{ntail}
{nlead} {lower} {plead} {phone}
{nlead} {initial}{ntail}
{nlead} {initial}, {thing} {num}
{nlead} {name}, {address}
{nlead} {name} of {firm}
{name} from {firm} {done} the {thing}.
{name} {done} the {thing}
{first} {done} the {thing} on {weekday}.
{alead} {address}{atail}
{alead} {address}{atail}
{alead} {address}{atail}
{alead} {address}{atail}
{plead} {phone}{ptail}
{plead} {phone}{ptail}
{plead} {phone}{ptail}
{plead} {phone}{ptail}
{plead} {phone} {plead} {phone}
{ilead} {id}{itail}
{ilead} {id}{itail}
{ilead} {id}{itail}
{ilead} {id}{itail}
{ilead} {id} of {name}
passport {passport}{itail}
Passport number {passport}{itail}
{ilead} or passport {passport}{itail}
{nlead} {name}, passport {passport}{itail}
{elead} {email}{ptail}
{elead} {hidden}{ptail}
""".strip().split("\n")

PLAIN = """
Dear all,
Dear client,
Dear members,
Good morning,
Hello there,
Hi all,
hi again,
Many thanks!
To whom it may concern,
{firm}
{firm}, bulletin {num}
{firm}, page {d5}
{firm} - {money}
{firm} {money}
{firm}, {place}
{firm} delivers for us.
{firm} {place} {num}
We thank {firm} for the {thing}.
Our {place} {premises} is open until {num}.
Our {roadname} {premises} is open until {num}.
The {roadname} {premises} has moved.
{place} {premises}
{cap} {thing}
The {cap} {thing} is sold by {firm}.
The {cap} {thing} comes from {firm} again.
A {cap} {thing} fits every {thing}.
Parcel {d4} {d4} {d3} has left {place}.
Parcel {d4} {d4} {d4} {d4} was {done}.
Shipment {code} left {firm}. Worth {money}.
Shipment above left {firm}. Worth {money}.
Barcode {d13}, pack {d6}.
GTIN {d8}{d5}, pack {d6}.
Counter {d3}/{d5}/{d2} was read.
Lot {letter}{d6}-{d3} is {state}.
Part {letter}{d8}, shelf {num}.
VAT number GB {d3} {d4} {d2}
Tax ID GB{d9}, {firm}
VAT GB{d3} {d4} {d2}, registered in {place}.
Company number {d8}, {place}.
Bank code {d2}-{d2}-{d2}, account {d8}.
Account {d8} at {firm}.
IBAN GB{d2} ABCD {d4} {d4} {d4} {d2}
Card **** {d4}
Card xxxx xxxx xxxx {d4} paid {money}.
Card ** ** ** {d4} was charged.
Item #{d4}: {num} * {num} pieces, length < {d2} cm.
{num} x {thing} at {money}
Pay ${num}.{d2} first and ${num}.{d2} later.
See @{word}_{d2} for more.
Follow @{word} today
You have {d3} points.
Purchase {code}
Purchase no {code}
Purchase #{d4}
Bill {code}
Reference {code} for {thing} {num}.
{code} {thing} {state}
Your {thing} purchase is at stage {d3}.
A voucher numbered {d3} was issued for the {thing}.
A third voucher, no {d3}, lists {thing}.
The cost of {thing} stays until month {d2}.
We have {d2} of {thing} left.
The {thing} was not charged.
Nobody has {done} the {thing}.
Allow {d3} hours for the {thing}.
- {thing} now at {money}
- {thing} {num}
* {thing} with {thing}
Row {d3} of the {doc}: {thing}
Pick up the {thing} at counter {d3}
Never store {thing} with box {d3}
Bring back the {thing} in {d3} days
Use {d3} x {thing} before
Leave the {thing} closed
Look at the top of every {thing}
{Thing} and {thing} apart
{Doc} {d2}/20{d2}
{Doc} of {thing}
How your {doc} works
{Thing} & {thing}
{Thing} details {d2}
Notice <{word}>
What we do next
Hours of the {premises}
{Thing} list {d2} v{d2}
Inside this {thing}
Sum {money}
{thing} {money}
{Thing} {num} {money}
Your money appears (read on below) on every row.
wget -q http://{word}.example/{d3}
SELECT id, amount FROM {word} WHERE amount > {d2}
while x < {d2}: send(x, {d3})
run --limit {d2} --pause {d3}s
if total > {d2}: print(total, {d3})
net = sum(row.amount for row in rows[:{d2}])
x = \\frac{{{d2}}}{{{d3}}}
y = 1.{d2} a + 2.{d3} b
{d2}.{d2}.20{d2} at {d2}:{d2}
On {weekday} the {thing} is {state}.
{weekday}: {thing} {state}
{place}, {weekday}
In {place} the {thing} costs {money}.
{word} {word} {word} {word} {num}
The {word} {word} of {word} {num} and {word}.
{flead} {firm}{ftail}
{flead} {firm}{ftail}
{flead} {firm}{ftail}
{flead} {firm}{ftail}
{firm}{ftail}
{firm}{ftail}
{firm}{ftail}
{firm}, {doc} {d5}
{firm}, {thing} {d5}
{nlead} {firm}{ftail}
The {cap} {thing} {state}
The {firm}{ftail}
{flead} the {cap} {thing}
{Thing} {state}
{Doc} {state}
{Thing} {doc}
{clead} {code}{itail}
{clead} {code}{itail}
{clead} {code}{itail}
{clead} {code}, {money}
{clead} {d8}{itail}
{clead} {d6}{itail}
{clead} {d13}{itail}
{clead} {d3} {d4} {d2}{itail}
{clead} {d4} {d4} {d3}
SELECT {word}, {word} FROM {word}
def {word}({word}): return {word}[{d2}]
{word}({word}, {d2})
{place} {state} {weekday}
{alead} {place}{ptail}
{alead} {roadname}{ptail}
""".strip().split("\n")

# Common first names of many countries.
FIRST = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth Richard Susan Joseph Karen Charles Nancy Daniel Lisa Matthew Betty Anthony Sandra Steven Ashley Andrew Donna Kenneth Emily George Carol Kevin Amanda Brian Melissa Edward Deborah Ronald Rebecca Timothy Helen "
    "Hans Ursula Klaus Ingrid Wolfgang Helga Stefan Sabine Jürgen Jörg Käthe Pierre Marie Jean Françoise Michel Hélène René Zoé Giovanni Giulia Marco Chiara Luca Carlos Carmen José Dolores Inés Joaquín Piotr Agnieszka Łukasz Małgorzata Jan Tereza Jiří Zdeněk Lars Astrid Erik Sigrid Bjørn Søren Åsa Mikko Aino "
    "Mehmet Ayşe Emre Elif Ali Omar Layla Khalid Amina Raj Priya Arjun Sunita Wei Mei Hiroshi Yuki Kenji Min-jun Kwame Ngozi Tunde Amara Dmitri Svetlana Boris Natasha Siobhan Niamh Declan Rhys Gwen Angus Isla Bo Al Jo Ed Mo Kim"
).split()
_ONSET = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn l m n p pl pr qu r s sch sh sk sl sm sn sp st str sw t th tr v w wh y z".split()
_NUCLEUS = "a a a e e e i i i o o o u u ai ea ee ie oa oo ou au y ä ö ü é".split()
_CODA = ["", "", "", *"b ck d ff g l ll lt m mp n nd ng nt p r rd rk rl rm rn rs rt s sk ss st t th x".split()]
_NAME_END = "son man mann er ers sen ski ska ov ova ini ez wood well by stead croft more more ley worth s o i a ard el ell".split()
_PLACE_END = "ton ham ford bury ley by wick thorpe field mouth bridge pool burg dorf hausen stadt ville court heim berg mere stead ness ow le port".split()
_ROAD_END = "field well mill moor brook gate hill wood water bank ing er".split()
_UK_ROAD = "Street Road Lane Avenue Close Court Drive Hill Rise Way Place Terrace Gardens Crescent Grove Row Mews Square".split()
_US_ROAD = "St St. Ave Ave. Blvd Blvd. Dr Dr. Rd Rd. Ln Pkwy Parkway Street Avenue Drive Road Lane Circle".split()
_DE_ROAD = "straße strasse str. weg platz gasse allee ring ufer damm".split()
_THING = (
    "mug|tea towel|brass screw|wall lamp|HDMI cable|ring binder B5|oak shelf|bicycle pump|service fee|tyre change|green tea|petrol|double room|steel pipe|zip bag|glue stick|sewing kit|ink bottle|saw blade|power bank|watering can|ceiling light|photo paper|kettle|frying pan|pillow case|door mat|window cleaner|car wash|train ticket|pepper mill|light switch|rain coat|"
    "tennis racket|chess set|yearly plan|gas meter|water filter|coffee beans|wool scarf|tool box|steel rope|candle|mirror|battery AA|safety goggles|timber board|sandwich|parking space|annual licence|data plan|router X2|spare wheel|seat cover|copper wire|pack of nails|soap bar"
).split("|")
_NLEAD = "Signed by|Booked by|On behalf of|c/o|Attn:|Contact:|Received from|Handed to|Paid by|Speak to|Regards from|Your adviser is|Driver:|Cashier|Guest|Patient|Tenant:|Prepared by|Approved by|Best,|Warm regards,|Respectfully,|The caller was|We met|Collected by|As agreed with|for|by|with|and|from|Customer|Client:|Owner|Mr and Mrs|Recipient:|thanks to|Meet|Payer|Bearer|Subscriber|Insured|Passenger|Resident|Employee|Member|Witness|Buyer".split("|")
_NTAIL = ["", "", ".", ".", ",", " on {weekday}", " at {num}", ", {role}", " ({role})", " today.", " and team", " tel {phone}", " <{email}>", ", {place}", ", {thing} {num}", " – {thing} {num}", " has {done} it."]
_ALEAD = "at|to|from|near|Address:|Deliver to|Ship to|lives at|moved to|the site|Collect from|Return to|Billing address:|Located at|Registered office|visit|property|Meet us at|and|for".split("|")
_ATAIL = ["", "", ".", ".", " on {weekday}.", " and ring {phone}.", " is {state}.", " by {num}", ". The {thing} is {state}.", ". {firm}", "\n{firm}", " before {weekday}", ". {Thing} {num}"]
_PLEAD = "call|ring|phone|tel|Tel:|mobile|fax|text|WhatsApp|dial|on|reach us on|hotline|or|number|contact|at|phone number is|to".split("|")
_PTAIL = ["", "", ".", ".", " today", " for {thing}.", " or write", ", ask for {first}", " on {weekday}", " ({role})", " soon."]
_ILEAD = "NI|NI number|NINO|insurance no|SSN|SSN:|social security no.|social security number|identity number|ID number|ID|national insurance|number|form".split("|")
_ITAIL = ["", "", ".", ".", " is {state}", " on {weekday}", ". Thank you.", ", {doc} {num}", " was {done}.", " for {thing}"]
_ELEAD = "mail|write to|email:|Email|reach us at|contact|send it to|copy to|via|at|under|to".split("|")
_FLEAD = "from|by|at|with|via|sold by|packed by|shipped by|on behalf of|your|visit|Regards from|The team of|Thank you,|Shop:|Merchant|Seller:|to|through|Sent by|today".split("|")
_FTAIL = ["", "", ".", ",", " {money}", ", {money}", " - {thing}", " in {place}", ", {doc} {num}", " today.", " Ltd", " {num}", ", {word} {d5}", " left {thing}", " is {state}"]
_CLEAD = "order|Order|purchase|ref|Ref:|invoice|tracking|batch|lot|serial|barcode|account|customer no|policy|case|ticket|item|parcel|VAT|code|Booking".split("|")
_DOC = "invoice|bill|contract|letter|form|estimate|price list|warranty|account|notice of delivery|record|summary".split("|")
_STATE = "ready|late|lost|on the way|back in stock|sold out|due|closed|paid|complete|in review|fine|wet|open".split("|")
_DONE = "signed|accepted|checked|collected|taken|packed|handled|fetched|prepared|opened|served|received|approved|repaired|picked up|returned|booked|paid".split("|")
_ROLE = "sales|billing|customer care|manager|accounts team|driver|support|secretary|head of purchasing|stores".split("|")
_PREMISES = "shop|store|office|depot|warehouse|site|branch|showroom|workshop|garage|outlet|market".split("|")
_TRADE = "Bakery|Plumbing|Motors|Stationers|Clinic|Insurance|Travel|Florist|Garden Centre|Software|Logistics|Media|Dairy|Butchers|Supplies|Group|Services|Trading|Direct|Wholesale|Gas|Water|Airways|Hotel|Pharmacy|Books|Cafe|Foods|Energy|Electrical|Hardware|Bank|Tools|Telecom|Office|Parts|Rail|Timber|Grocers|Fuels".split("|")
_WORDS = "the our a this each every with from about under over after before new old small large next first last big early full empty order price week month year day box desk floor room street house water paper light time work need want keep send call give take make find show hold move pay read write check and or but if when then than only also just not".split()


_LEADS = {"nlead": _NLEAD, "alead": _ALEAD, "plead": _PLEAD, "ilead": _ILEAD, "elead": _ELEAD, "flead": _FLEAD, "clead": _CLEAD}
_TAILS = {"{ntail}": _NTAIL, "{atail}": _ATAIL, "{ptail}": _PTAIL, "{itail}": _ITAIL, "{ftail}": _FTAIL}
#: Words that firms have in their names, for the tagger's features.
TRADE_WORDS = frozenset(w.lower() for t in _TRADE for w in t.split()) | {"company", "ltd", "limited", "plc", "gmbh", "inc", "llp", "sons", "shop", "store", "stores", "partners", "brothers", "centre"}


class Filler:
    def __init__(self, seed: int, listed_names: list[str]):
        self.r = random.Random(seed)
        self.listed_names = listed_names

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def stem(self, low: int = 1, high: int = 3) -> str:
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) + (r.choice(_CODA) if r.random() < 0.6 else "") for _ in range(r.randint(low, high)))

    def cap(self) -> str:
        return self.stem(2, 3).capitalize()

    def word(self) -> str:
        return self.r.choice(_WORDS) if self.r.random() < 0.6 else self.stem()

    def surname(self) -> str:
        r = self.r
        s = (self.stem(1, 2) + r.choice(_NAME_END)).capitalize() if r.random() < 0.6 else self.cap()
        x = r.random()
        if x < 0.1:
            return f"{s}-{self.cap()}"
        if x < 0.16:
            return f"O{r.choice(['’', chr(39), chr(39)])}{s}"
        if x < 0.2:
            return f"{r.choice(['Mc', 'Mac'])}{s}"
        return f"{r.choice(['van', 'de', 'von', 'da', 'al'])} {s}" if x < 0.23 else s

    def first(self) -> str:
        r = self.r
        return r.choice(FIRST) if r.random() < 0.6 else self.stem(1, 2)[:9].capitalize()

    def name(self) -> str:
        r = self.r
        if self.listed_names and r.random() < 0.2:
            return r.choice(self.listed_names)
        middle = r.choice(["", "", "", "", "", "", f"{r.choice('ABCDEGHJKLMNPRST')}. ", f"{self.first()} "])
        return f"{self.first()} {middle}{self.surname()}"

    def turned(self) -> str:
        return f"{self.surname()}, {self.first()}"

    def initial(self) -> str:
        return f"{self.r.choice('ABCDEFGHIJKLMNOPRSTUVWYZ')}. {self.surname()}"

    def upper(self) -> str:
        return self.name().upper()

    def lower(self) -> str:
        return self.name().lower()

    def place(self) -> str:
        return (self.stem(1, 2) + self.r.choice(_PLACE_END)).capitalize() if self.r.random() < 0.8 else self.cap()

    def placeupper(self) -> str:
        return self.place().upper()

    def roadname(self) -> str:
        r = self.r
        return f"{(self.stem(1, 2) + r.choice(_ROAD_END)).capitalize() if r.random() < 0.7 else self.cap()} {r.choice(_UK_ROAD)}"

    def postcode(self) -> str:
        r = self.r
        letters = "ABCDEFGHIJKLMNOPRSTUVWXYZ"
        code = f"{r.choice(letters)}{r.choice(['', *letters])}{r.randint(1, 99)}{r.choice(['', '', '', 'A', 'W'])} {r.randint(0, 9)}{r.choice(letters)}{r.choice(letters)}"
        return code.lower() if r.random() < 0.1 else code

    def address(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.5:
            unit = r.choice(["", "", "", f"Flat {r.randint(1, 99)}, ", f"Unit {r.choice('ABCDEFG')}{r.choice(['', r.randint(1, 9)])}, ", f"Apt {r.randint(1, 99)}, ", f"{self.cap()} House, ", f"Suite {r.randint(1, 40)}, ", f"flat {r.randint(1, 30)}{r.choice('abc')}, "])
            end = r.choice([f", {self.postcode()}", f", {self.postcode()}", f", {self.postcode()}", f" {self.postcode()}", ""])
            return f"{unit}{r.randint(1, 300)}{r.choice(['', '', '', '', 'a', 'B'])} {self.roadname()}, {self.place()}{end}"
        if kind < 0.78:
            unit = r.choice(["", "", f", Apt {r.randint(1, 99)}", f" #{r.randint(1, 99)}", f", Suite {r.randint(1, 900)}", f" Unit {r.randint(1, 20)}"])
            side = r.choice(["", "", "", "N. ", "S. ", "East ", "West ", "N ", "SW "])
            state = "".join(r.choice("ABCDEFGHIKLMNOPQRSTUVWXYZ") for _ in range(2))
            return f"{r.randint(1, 9999)} {side}{self.cap()} {r.choice(_US_ROAD)}{unit}, {self.place()}, {state} {self.digits(5)}{r.choice(['', '', '', '-' + self.digits(4)])}"
        end = r.choice(_DE_ROAD)
        street = self.stem(1, 3).capitalize() + r.choice([end, end, " " + end.capitalize()])
        return f"{street} {r.randint(1, 150)}{r.choice(['', '', '', 'a', 'c'])}, {self.digits(5)} {self.place()}"

    def email(self) -> str:
        r = self.r
        f, s = r.choice(FIRST).lower(), self.stem(1, 3)
        local = r.choice([f"{f}.{s}", f"{f}_{s}", f"{f}_{s}{r.randint(1, 99)}", f"{f}-{s}", f"{s}.{f}", f"{f[0]}{s}", f"{f[0]}.{s}", f"{f}{r.randint(1, 2000)}", f"{s}", f"{s}{f[0]}", f"{f}+{s}"])
        host = r.choice([f"{self.stem(1, 3)}.example", f"{self.stem(1, 2)}-{self.stem(1, 2)}.test", f"mail.{self.stem(1, 3)}.org", f"{self.stem(1, 3)}.co.uk", f"{self.stem(1, 3)}.com", f"{self.stem(1, 2)}.de", f"{self.stem(1, 2)}.{self.stem(1, 2)}.net"])
        out = f"{local}@{host}"
        return out.upper() if r.random() < 0.06 else out

    def hidden(self) -> str:
        return self.email().replace("@", self.r.choice(["(at)", " [at] ", " at ", " (at) ", "[at]"]))

    def phone(self) -> str:
        r, d = self.r, self.digits
        uk = f"{r.choice('123578')}{d(3)}"
        return r.choice([
            f"0{uk} {d(6)}", f"0{uk}{d(6)}", f"0{uk}-{d(3)}-{d(3)}", f"0{uk}-{d(6)}", f"(0{uk}) {d(6)}", f"0{uk} {d(3)} {d(3)}", f"+44 {uk} {d(6)}", f"+44 (0){uk} {d(6)}", f"0044 {uk} {d(6)}", f"+44{uk}{d(6)}", f"+44 {uk} {d(3)} {d(3)}",
            f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+44{d(10)}",
            f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"{r.randint(201, 989)}.{d(3)}.{d(4)}", f"({r.randint(201, 989)}) {d(3)}-{d(4)}", f"1-{r.randint(201, 989)}-{d(3)}-{d(4)}", f"+1 {r.randint(201, 989)} {d(3)} {d(4)}", f"+1-{r.randint(201, 989)}-{d(3)}-{d(4)}",
            f"0{d(2)} / {d(5)} {d(3)}", f"0{d(3)}/{d(7)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(5)} {d(3)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])

    def id(self) -> str:
        r, d = self.r, self.digits
        letters = "ABCEGHJKLMNOPQRSTWXYZ"
        two, last, x, y, z = r.choice(letters) + r.choice(letters), r.choice("ABCD"), d(2), d(2), d(2)
        out = r.choice([f"{two}{x}{y}{z}{last}", f"{two} {x} {y} {z} {last}", f"{two}-{x}-{y}-{z}-{last}", f"{two} {x}{y}{z} {last}", f"{two}{x}{y}{z} {last}"])
        if r.random() < 0.6:
            return out.lower() if r.random() < 0.2 else out
        sep = r.choice(["-", "-", "–", " ", " "])
        return f"{d(3)}{sep}{x}{sep}{d(4)}"

    def passport(self) -> str:
        r, d = self.r, self.digits
        letters = "ABCEGHJKLMNOPQRSTWXYZ"
        return r.choice([d(9), f"{r.choice(letters)}{d(8)}", f"{r.choice(letters)}{r.choice(letters)}{d(7)}", f"{r.choice(letters)}{r.choice(letters)}{d(8)}", f"{r.choice(letters)}{d(7)}"])

    def firm(self) -> str:
        r = self.r
        a, b, f = self.cap() if r.random() < 0.5 else self.place(), self.cap() if r.random() < 0.5 else self.surname(), r.choice(_TRADE)
        legal = r.choice(["Ltd", "Limited", "plc", "GmbH", "Inc.", "LLP"])
        return r.choice([f"{a} {f}", f"{a} {f}", f"{a} & {b} {f}", f"The {a} {f} Company", f"The {a} {f}", a, f"{a} & {b}", f"{a} & {b} {legal}", f"{a} {f} {legal}", f"{a} {r.choice(_TRADE)} {f}", f"{a} & Sons"])

    def money(self) -> str:
        return self.r.choice([f"{self.r.choice('£€$')}{self.r.randint(1, 2000)}.{self.digits(2)}", f"{self.r.randint(1, 900)}.{self.digits(2)} {self.r.choice(['GBP', 'EUR', 'USD'])}"])

    def code(self) -> str:
        s = self.stem(1, 2)[: self.r.randint(2, 3)].upper()
        return self.r.choice([f"{s}-{self.digits(8)}", f"{s}{self.digits(8)}", f"{s} {self.digits(8)}", f"{s}-{self.digits(6)}-{self.digits(2)}", f"{s}{self.digits(5)}", f"{s}-{self.digits(8)}-{self.stem(1, 1).upper()}-{self.r.randint(1, 9)}"])

    def num(self) -> str:
        return str(self.r.randint(1, self.r.choice([9, 99, 999, 99999])))

    def fill(self, slot: str) -> str:
        r = self.r
        if slot[0] == "d" and slot[1:].isdigit():
            return self.digits(int(slot[1:]))
        lists = {"title": ["Mr", "Mrs", "Ms", "Mx", "Miss", "Dr", "Dr.", "Prof.", "Mr."], "weekday": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"], "thing": _THING, "doc": _DOC, "state": _STATE, "done": _DONE, "role": _ROLE, "premises": _PREMISES, "letter": list("ABCDEFGHKLMNPRSTX")}
        if slot in lists:
            return r.choice(lists[slot])
        if slot in _LEADS:
            return r.choice(_LEADS[slot])
        if slot.lower() in lists:
            return r.choice(lists[slot.lower()]).capitalize()
        return getattr(self, slot)()


def labelled_table(listed_names: list[str], per_frame: int = 40, seed: int = 7, frames: tuple[str, ...] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): a few thousand rows, some of several sentences."""
    f = Filler(seed, listed_names)
    single = []
    for frame in frames if frames is not None else (*FRAMES, *PLAIN):
        literal = frame.replace("{{", "\x01").replace("}}", "\x02")
        for _ in range(per_frame):
            text, spans = "", []
            at = 0
            chosen = literal
            for slot, tails in _TAILS.items():
                if slot in chosen:
                    chosen = chosen.replace(slot, f.r.choice(tails))
            for m in re.finditer(r"\{(\w+)\}", chosen):
                text += chosen[at : m.start()]
                value = f.fill(m[1])
                if not text and m[1] == "done":
                    value = value.capitalize()
                if m[1] in SLOTS:
                    spans.append((len(text), len(text) + len(value), SLOTS[m[1]]))
                text += value
                at = m.end()
            text = (text + chosen[at:]).replace("\x01", "{").replace("\x02", "}")
            if f.r.random() < 0.25 and any(k == "address" for _, _, k in spans):
                text = re.sub(r", (?=[A-Z0-9])", lambda m: ",\n" if spans[-1][0] < m.start() < spans[-1][1] or f.r.random() < 0.3 else m[0], text)
            single.append((text, spans))
    f.r.shuffle(single)
    rows, k = [], 0
    while k < len(single):
        n = f.r.choice([1, 1, 1, 2, 3])
        text, spans = "", []
        for t, s in single[k : k + n]:
            gap = f.r.choice(["\n", " "]) if text else ""
            spans += [(a + len(text) + len(gap), b + len(text) + len(gap), kind) for a, b, kind in s]
            text += gap + t
        rows.append((text, spans))
        k += n
    return rows


def split_frames(part: int, of: int = 5) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(frames to train on, frames kept out): every ``of``-th frame is kept out."""
    every = (*FRAMES, *PLAIN)
    return tuple(x for k, x in enumerate(every) if k % of != part), tuple(x for k, x in enumerate(every) if k % of == part)
