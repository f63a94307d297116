"""The small labelled table that the personal-information tagger is trained from.

Carrier sentences with slots, written for this purpose after reading the project's tables; many follow their wording. Slots in capitals are filled with invented personal information and
labelled; slots after ~ are filled with invented other matter (references, prices, localities, projects, firms).
Names are made of random syllables, so that the tagger learns shapes and contexts and not names.
"""

from __future__ import annotations

import random

from talkmill.llm.language_seed import SEED

WITH = """my name is PERSON|this is PERSON|PERSON here, any update?|PERSON here|regards, PERSON|Thanks PERSON|thanks, PERSON|I spoke with PERSON last week|please speak to PERSON about it|PERSON will come for the site visit
agreement will be in the name of PERSON|the flat is for PERSON|ask PERSON to call me|my wife PERSON wants to see it|sincerely PERSON|Mr PERSON called yesterday|met PERSON at the office|contact PERSON for the papers|I am PERSON|PERSON from the bank called me|sent by PERSON
me llamo PERSON y busco casa|mi nombre es PERSON|saludos, PERSON|mein Name ist PERSON und ich suche eine Wohnung|viele Grüße PERSON|ich heiße PERSON|chamo-me PERSON e procuro casa|o meu nome é PERSON|cumprimentos, PERSON|mera naam PERSON hai aur ghar chahiye|main PERSON bol raha hoon
मेरा नाम PERSON है और मुझे घर चाहिए|मैं PERSON बोल रहा हूँ|मेरा नाम DEVA है और मुझे घर चाहिए|मेरा नाम DEVA है|माझं नाव PERSON आहे आणि मला घर हवं आहे|माझं नाव DEVA आहे आणि मला घर हवं आहे|నా పేరు PERSON నాకు ఇల్లు కావాలి|నా పేరు TELU నాకు ఇల్లు కావాలి
call me on PHONE|my number is PHONE|whatsapp: PHONE|whats app no PHONE only after six|office line PHONE is always busy|You can also reach the site office at PHONE.|PHONE|tel PHONE|mobile PHONE please|ring PHONE in the evening|my phone: PHONE|sms to PHONE
mera number PHONE hai, shaam ko call karna|मेरा नंबर PHONE है, शाम को फोन कीजिए|माझा नंबर PHONE आहे, संध्याकाळी फोन करा|నా నంబర్ PHONE కి సాయంత్రం ఫోన్ చేయండి|mi número es PHONE, llámeme por la tarde|o meu número é PHONE, ligue à tarde|Sie erreichen mich unter PHONE|meine Nummer ist PHONE
my email: EMAIL|mail me at EMAIL|send the papers to EMAIL|floor plan can go to EMAIL, thanks|EMAIL is my id for mails|reach us on EMAIL please|EMAIL|write to EMAIL|मेरा ईमेल EMAIL है उस पर भेज दीजिए|माझा ईमेल EMAIL आहे|వివరాలు EMAIL కి పంపండి అండి|mi correo es EMAIL|o meu correio é EMAIL|meine Adresse für Mails ist EMAIL|mera email EMAIL hai
IDNO attached|KYC done, IDNO|buyer details: IDNO|for the agreement use IDNO|please note IDNO for the loan file|IDNO|here is my IDNO|my IDNO as asked|copy of IDNO is with you|IDBARE attached|KYC done, IDBARE|buyer details: IDBARE|for the agreement use IDBARE|please note IDBARE for the loan file|IDBARE
current address is ADDR|we live at ADDR|courier it to ADDR|pick me up from ADDR on the way|pick me up from ADDR|ADDR|my home is ADDR|send it to ADDR please|vivo en ADES|vivimos en ADES|ich wohne im ADDE|ich wohne in der ADDE|moro na ADPT|vivo na ADPT|हमारा पता ADHI है|आमचा पत्ता ADMR आहे|మా చిరునామా ADTE
agreement will be in the name of PERSON and my number is PHONE|my name is PERSON, mail me at EMAIL|PERSON, PHONE|regards, PERSON, PHONE|Thanks PERSON and send the papers to EMAIL|PERSON, ADDR|this is PERSON, buyer details: IDNO"""
WITHOUT = """token amount is ~num thousand and is refundable within ~num days|survey papers for plot ~num are with our legal desk|block ~num faces ~street and block ~num faces the park|toll and parking come to ~price for the whole year|the ~area sq ft plan faces the park, the other one faces the road
registration charges are extra, about ~num percent of the value|the ~numbhk is ~area sq ft and priced at ~price crore with taxes|tower near the lake, block ~num, is it sold out?|plot of ~area sq yards facing east please|~num% discount was promised during the site visit|seen on your page: ~num units @ ~area, which floor are they
need the layout drawing of the ~area sq ft unit|emi of ~price is too much for us|is there a grace period of ~num days for the token amount|ok then ~price crore is my final offer|the offer was ~price all in, has that changed|flat ~num and flat ~num both look the same on the plan|the brochure says ~area sq ft but carpet ~area is much less
change it to ~numbhk, we need one more room for my parents|the price has gone up again, last ~month it was ~price crore|hamara budget ~num lakh ke aas paas hai usse zyada nahi ho payega|हमारा बजट लगभग ~num लाख है और थोड़ा बढ़ सकता है|మా బడ్జెట్ సుమారు ~num లక్షలు, కొంచెం పెరగవచ్చు|mi presupuesto es de unos ~num mil, no puedo pagar más
project registration REF is listed on the state portal|your quotation number is REF, valid for ~num days|invoice REF dated ~num ~month shows the full break-up|loan file REF is still pending with ~bank|booking id REF is confirmed|the loan number is REF|GST invoice REF|receipt REF for the token|survey no ~num/~num at ~loc, is the title clear|survey no ~num at ~loc
project registration REF is listed|your quotation number is REF|loan file REF is still pending with ~bank|Registration REF is in order|reference REF|ticket REF was closed
is ~name ~firmword the same builder as ~proj?|~name ~firmword built the earlier phase in ~loc|CRM note says ~name ~projword, ignore it|~bank and two other lenders have cleared the project|is ~proj approved by ~bank|the owners of ~proj hold their ~word on ~day, visits start after that|the ~word garden behind ~proj looks good in the photos
we hope the ~word on ~street stays open, it is near ~loc|is the road in front of ~proj forty feet or sixty feet wide?|handover for ~proj is planned for ~month ~year|we have ~num units left in ~proj, starting at ~num lakhs|parking is ~num thousand extra per slot in ~proj|mason work on the ~numth floor ends in ~month|Mason work on the ~numth floor ends in ~month
any ~word homes near the school in ~loc?|not keen on ~loc, too much traffic in the evening|do you have a ~numbhk in ~loc under ~num lakhs|flat in ~loc or plot in ~loc, either is fine with us|what is the rate per sq ft in ~loc now|our company needs ~num flats for staff near ~loc by ~month|rate @~area per sqft looks high for ~loc|the ~loc site is open from ten to six on all days
we have possession before ~month ~year|we want possession before ~month ~year|can we visit on ~day around ~numpm|shall I book a visit for ~day at ~num am|no rush from our side, maybe by ~month|can you hold unit ~num till ~day|I will decide after talking to my wife|my father wants to see it first before we say yes|how much is the booking amount and is it refundable
~proj में अब कितने मकान बचे हैं|क्या ~loc में ~num बीएचके फ्लैट मिल सकता है|~loc मध्ये ~num बीएचके फ्लॅट आहे का|~proj मध्ये आता किती घरं शिल्लक आहेत|~loc లో ~num బీహెచ్‌కే ఫ్లాట్ ఉందా అండి|~proj లో ఇంకా ఎన్ని ఇళ్ళు మిగిలి ఉన్నాయి|bhaiya ~loc mein ~num bhk ka rate kya chal raha hai
¿cuántas viviendas quedan libres en ~proj?|buenas, ¿tienen un piso de ~num dormitorios en ~loc?|quantas casas ainda estão livres em ~proj?|bom dia, vocês têm um apartamento de ~num quartos em ~loc?|guten Tag, gibt es noch eine Wohnung mit ~num Zimmern in ~loc?|wie viele Wohnungen sind in ~proj noch frei?|unser Budget liegt bei etwa ~num tausend, mehr geht leider nicht|o meu orçamento é de uns ~num mil
we can offer ~num% off if the booking is made before ~day|the price list changes on the first of ~month|who will handle the registration and what papers are needed|the society at ~proj has a rooftop garden and a clubhouse|there is a ~word flat in ~loc that may suit you better|hello, is this group for ~proj buyers?|is the villa at ~proj still available|what about maintenance charges and library room?
let me ask the site team about it, I revert by tomorrow|kindly share your budget range and preferred location|noted, ready to move options only|ok noted|send photos|the ready wing|~num lakhs|~numbhk|~day works|thanks|sure|price?|[media: image]|our ceiling is ~num lakhs, could go up to ~num if the power backup is included
we saw a villa on the ~numth floor but the kitchen is dark|the sunny hall is part of phase two|a sunny corner flat|grace period|the court ordered a stay on the plot|there is hope for a lower price|the amber wall tiles look good|lily pond near the gate|summit meeting on ~day|the field behind the park is empty|heron lake view|enquiry desk joined the chat|Group member ~num left
flat ~num, block ~num|units ~num and ~num are gone|phase ~num of ~proj|house of ~num rooms|road of ~num feet|plot no ~num and plot no ~num are sold|the house number ~num looks better on the plan|street parking on ~street is full|~proj, ~loc|~loc|~street is closed|the flat on ~street|the total is ~price rupees|Rs ~price per ~month|USD ~price|valid till ~num/~num/~year|at ~num:~num on ~num/~num/~year
my ~kin wants to see it first before we say yes|our family wants to see it first|I will decide after talking to my ~kin|two plans will be printed for my ~kin before the visit|My ~kin will visit alone on ~day|need one more room for my ~kin|My ~kin prefers the lower floor|Our family is coming|the bank wants to see it first
कीमत बहुत ज्यादा है, कुछ कम कीजिए|पिताजी से पूछकर ही मैं बताऊँगा|हमें दो कमरे की जरूरत है|मला पुढच्या महिन्यात घर हवं आहे|आमचं बजेट साधारण ~num लाख आहे, थोडं वाढेल|या भागात पाण्याची सोय आहे ना|किंमत जास्त वाटते, काही कमी होईल का|आम्हाला गाडी ठेवायला जागा हवी आहे|कर्ज मंजूर व्हायला किती दिवस लागतील|मुझे अगले साल तक घर चाहिए|लोन कब तक मिलेगा यह बताइए
మాకు పార్కింగ్ అవసరం|ధర చాలా ఎక్కువగా ఉంది కొంచెం తగ్గించండి|వచ్చే నెలలోపు మాకు ఇల్లు కావాలి|లోన్ ఎన్ని రోజుల్లో వస్తుంది చెప్పండి|నాన్నగారిని అడిగి చెప్తాను|me parece caro para esa zona|tengo que hablarlo con mi mujer|das muss ich erst mit meiner Frau besprechen|tenho de falar com a minha mulher|papa se puchkar bataunga|loan ka kaam kab tak ho jayega
~deva ~deva ~deva है|~deva ~deva ~deva ~deva आहे|~deva में ~deva ~deva ~deva हैं|~deva ~deva, ~deva ~deva|~deva ~deva ~deva ~deva ~deva क्या|~telu ~telu ~telu ~telu|~telu ~telu ~telu అండి|~telu ~telu ~telu ~telu, ~telu ~telu|~deva ~deva की ~deva ~deva है|~deva ~deva ~deva हो ~deva है|~telu మరియు ~telu ~telu|~deva ~deva ~deva ~deva ~deva ~deva
is ~proj approved by ~bank|is ~proj approved by ~bank|the rose garden behind ~proj looks good|handover for ~proj is planned|is the flat at ~proj still available|The society at ~proj has a gym
would a ~home on a higher floor work for you?|is the ~home at ~proj still available|any ~word ~home near the school in ~loc?|we saw a ~home on the ~numth floor but the kitchen is dark|There is a ~word ~home in ~loc that may suit you better|would an office unit or a ~home work for you|The society at ~proj has a ~place and a ~place.|what about maintenance charges and ~place?|the ~place is part of phase two, not phase one"""
_HOME = "flat|villa|farm house|row house|office unit|corner plot|duplex|studio|penthouse|plot|shop|cottage".split("|")
_PLACE = "covered parking|jogging track|rainwater pit|borewell|small gym|rooftop garden|clubhouse|library room|security cabin|solar heater|lift on both sides|children's play area".split("|")
_KIN = "wife|husband|son|daughter|brother|sister|elder brother|younger sister|father|mother|mother in law|business partner|son abroad|uncle|cousin".split("|")
_WORDS = "rose hope park court summit lily field grace sunny mason amber heron joy iris dawn olive hazel ruby forest lane hill".split()
_FIRM = "Towers|Constructions|Builders|Developers|Realty|Estates|Housing Finance|Bank|Credit|Infra|& Sons|Group|Associates".split("|")
_PROJECT = "Heights|Court|Gardens|Towers|Residency|Enclave|Meadows|Park|Rise|Square|House|Terraces|Fields|Crest|Walk|Loop".split("|")
_STREET = "Lane|Road|Street|Row|Avenue|Close|Cross|Main|Drive|Way|Path".split("|")
_STREETWORD = "Mill Pond|Canal Bank|Temple Tank|Old Market|Station|Orchard|Cooper|Harbour|Church|Garden|Barley|Saddlers|Kings|River|Cedar|Tanners|2nd|4th|7th|First|Third".split("|")
_MONTH = "January February March April May June July August September October November December".split()
_DAY = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_DIGITS = "zero one two three four five six seven eight nine".split()
_SYL = "ba be bi bra da dre du el fa fin ga gri ha hel in ja jo ka kel kri la lin ma mel mi na ni or pa pri ra ri ro sa shi so sul ta the tri u va vel vi wa ya ze zo".split()
_END = "n|r|l|s|th|sh|d|m|an|esh|ika|ar|ini|am|ell|ov|as|ur".split("|")
_DEVA = "क ख ग च ज त द न प ब म र ल व श स ह".split()
_DEVA_V = ["ा", "ि", "ी", "े", "ो", "ु", ""]
_TELU = "క గ చ జ త ద న ప బ మ ర ల వ శ స".split()
_TELU_V = ["ా", "ి", "ీ", "ె", "ో", "ు", ""]
_HOST = "example.com example.org mail.example post.test desk.test homes.example mx.office.example corp.invalid webmail.test".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.listed: set[str] = set()  # names that the invented name list holds

    def name(self) -> str:
        r = self.r
        out = ("".join(r.choice(_SYL) for _ in range(r.choice([1, 2, 2, 3]))) + r.choice(_END)).capitalize()
        if r.random() < 0.75:
            self.listed.add(out.lower())
        return out

    def num(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def person(self) -> str:
        r = self.r
        n = self.name() if r.random() > 0.12 else r.choice(_WORDS).capitalize()
        k = r.random()
        if k > 0.12 and k < 0.72:
            n += " " + self.name()
        elif k >= 0.72 and k < 0.80:
            n += " " + r.choice("ABCDEGHJKLMNPRSTVYZ") + "."
        elif k >= 0.80 and k < 0.86:
            n = r.choice("ABCDEGHJKLMNPRSTVYZ") + ". " + n
        elif k >= 0.86 and k < 0.94:
            n = r.choice(["Mr", "Mrs", "Ms", "Dr", "Shri", "Smt"]) + r.choice([" ", ". "]) + n
        return r.choice([n, n, n, n.lower(), n.upper()])

    def indic(self, cons: list[str], vows: list[str]) -> str:
        word = lambda: "".join(self.r.choice(cons) + self.r.choice(vows) for _ in range(self.r.choice([2, 3, 4])))
        return word() + (" " + word() if self.r.random() < 0.5 else "")

    def phone(self) -> str:
        r, d = self.r, self.num
        x = r.choice("56789") + d(9)
        forms = [x, x, f"+91{x}", f"+91 {x[:5]} {x[5:]}", f"{x[:5]}-{x[5:]}", f"{x[:5]} {x[5:]}", f"{x[:3]}.{x[3:6]}.{x[6:]}", f"0{x}", f"{x[:4]} {x[4:7]} {x[7:]}", f"91-{x[:3]}-{x[3:6]}-{x[6:]}", f"({d(3)}) 555-{d(4)}", f"+1-{d(3)}-555-{d(4)}", f"+1 ({d(3)}) 555 {d(4)} ext {d(3)}", f"07{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"{x[:5]}/{x[5:]}", f"+{x[:2]} {x[2:]}", f"+49 30 {d(7)}", f"0{x}", f"07{d(3)} {d(6)}", f"{x[:6]}\n{x[6:]}", f"{x[:5]}-{x[5:]}"]
        if r.random() < 0.08:
            return " ".join(_DIGITS[int(c)] for c in x)
        if r.random() < 0.07:
            return f"+91 {x[:5]} {x[5:]}".translate(str.maketrans("0123456789", "०१२३४५६७८९"))
        return r.choice(forms)

    def email(self) -> str:
        r = self.r
        a, b = self.name().lower(), self.name().lower()
        local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{a}{r.randrange(99)}", f"{b}_{a[0]}", f"{a}+flat", a])
        host = r.choice(_HOST)
        k = r.random()
        if k < 0.12:
            return f"{local}[at]{host}"
        if k < 0.24:
            return f"{local} at {host.replace('.', ' dot ')}"
        if k < 0.32:
            return f"{local} (at) {host.replace('.', ' (dot) ')}"
        out = f"{local}@{host}"
        return r.choice([out, out, out, out.upper(), f"<{out}>"])

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def bare_id(self) -> str:
        d = self.num
        a = self.r.choice("01") + d(3)
        return self.r.choice([f"{a} {d(4)} {d(4)}", f"{a}-{d(4)}-{d(4)}", f"{self.letters(5)}{d(4)}{self.letters(1)}", f"000-{d(2)}-{d(4)}", f"{self.letters(1)}{d(7)}", f"{a}{d(8)}", f"{self.letters(5)}{d(4)}{self.letters(1)}".lower()])

    def id_number(self) -> str:
        r, d = self.r, self.num
        twelve = r.choice([f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", d(12)])
        licence = r.choice([f"{self.letters(3)}{d(7)}", f"{self.letters(2)}{d(2)} 20{d(2)} {d(7)}"])
        pan = f"{self.letters(5)}{d(4)}{self.letters(1)}"
        out = r.choice(
            [f"{r.choice(['aadhaar', 'Aadhar no', 'aadhaar number', 'UID:', 'uid', 'id proof', 'national id', 'identity number'])}\x00{twelve}"] * 3
            + [f"{r.choice(['PAN', 'pan card', 'tax id', 'PAN no', 'tax number'])}\x00{pan}", f"{r.choice(['passport', 'passport number', 'passport no.'])}\x00{self.letters(1)}{d(7)}", f"{r.choice(['SSN:', 'ssn', 'social security'])}\x00{d(3)}-{d(2)}-{d(4)}", f"{r.choice(['DL no', 'driving licence', 'driver license', 'voter id', 'voter card', 'EPIC'])}\x00{licence}"]
        )
        return r.choice([out, out, out, out.lower()])

    def ref(self) -> str:
        d = self.num
        return self.r.choice([f"P0{d(10)}", f"REF-{d(9)}", f"LN-{d(7)}", f"BKG{d(8)}", f"QT/{d(5)}/26", f"44000{d(5)}", f"44{d(8)}", f"INV/{d(4)}/{d(3)}", f"UH{d(9)}", f"HL{d(10)}"])

    def street(self) -> str:
        return f"{self.r.choice(_STREETWORD)} {self.r.choice(_STREET)}"

    def place(self) -> str:
        return (self.r.choice(_SYL) + self.r.choice(_SYL)).capitalize() + self.r.choice(["pur", "palli", "gudem", "mere", "field", "stead", "vale", "nagar", "pet", "lea"])

    def project(self) -> str:
        r = self.r
        if r.random() < 0.4:  # two words that name neither a person nor a kind of building
            return f"{r.choice([self.place(), self.name(), r.choice(_WORDS).capitalize()])} {r.choice([self.place(), self.name(), 'One', 'Nine', 'Kite', 'Swan'])}"
        return r.choice([self.name(), r.choice(_WORDS).capitalize(), self.place()]) + " " + r.choice(_PROJECT)

    def address(self) -> str:
        r, n, s, p = self.r, self.r.randrange(1, 250), self.street(), self.place()
        pin = "0" + self.num(5)
        out = r.choice([f"House #{n}, {s}", f"Flat {n}, {self.project()} Residency, {r.randrange(200)} {s}, {p}", f"plot no {n}, {s}, {p} {pin}", f"{p}, {s}, house number {n}", f"{n}, {s}, {p} - {pin}", f"{n} {s}, apt {r.randrange(60)}", f"{n} {s}", f"{n} {s}, {p}", f"House #{n}, {s}\n{p}", f"H.No {r.randrange(20)}-{r.randrange(10)}-{n}, {s}, {p}", f"C/o guard room, {n}-{r.choice('AB')} {s.upper()}, {p.upper()}", f"door no. {n}/{r.choice('ABC')}, {s}, opp water tank, {p}", f"{n}/{r.choice('ABC')}, {s}, opp water tank, {p}", f"house {n}, {s}, {p} {pin}", f"apartment {n}, {s}"])
        if r.random() < 0.1:  # the form that is hardest without capitals
            out = f"{n} {s}, {p}".lower()
        return out.lower() if r.random() < 0.25 else out

    def fill(self, slot: str) -> str:
        r = self.r
        made = {
            "PERSON": self.person, "PHONE": self.phone, "EMAIL": self.email, "IDNO": self.id_number, "IDBARE": self.bare_id, "ADDR": self.address, "REF": self.ref,
            "DEVA": lambda: self.indic(_DEVA, _DEVA_V), "TELU": lambda: self.indic(_TELU, _TELU_V),
            "ADES": lambda: f"{r.choice(['calle', 'avenida', 'plaza'])} {self.name()} {r.randrange(200)}, piso {r.randrange(9)}", "ADDE": lambda: f"{self.name()}{r.choice(['straße', 'weg', 'bogen', 'gasse', 'platz'])} {r.randrange(200)}{r.choice([', zweiter Stock', ', erster Stock', ''])}",
            "ADPT": lambda: f"{r.choice(['rua', 'avenida'])} {r.choice(['das', 'do', 'da'])} {self.name()} {r.randrange(200)}, {r.randrange(9)}º andar", "ADHI": lambda: f"मकान नंबर {r.randrange(200)}, {self.indic(_DEVA, _DEVA_V)} रोड, {self.indic(_DEVA, _DEVA_V)}",
            "ADMR": lambda: f"घर क्रमांक {r.randrange(200)}, {self.indic(_DEVA, _DEVA_V)} रस्ता", "ADTE": lambda: f"ఇంటి నంబర్ {r.randrange(200)}, {self.indic(_TELU, _TELU_V)} రోడ్డు",
            "num": lambda: str(r.randrange(1, 99)), "area": lambda: str(r.randrange(40, 480) * 10), "price": lambda: r.choice([f"{r.randrange(1, 9)}.{self.num(2)}", f"{self.num(2)},{self.num(3)}", f"1,{self.num(2)},50,000", f"{self.num(2)},00,000"]),
            "loc": self.place, "proj": self.project, "name": self.name, "firmword": lambda: r.choice(_FIRM), "projword": lambda: r.choice(_PROJECT), "bank": lambda: r.choice([f"{self.place()} Bank", f"{self.name()} Credit", f"{self.name()} Housing Finance", f"{self.name()} Cooperative"]),
            "word": lambda: r.choice(_WORDS), "street": self.street, "month": lambda: r.choice(_MONTH), "day": lambda: r.choice(_DAY), "year": lambda: f"20{r.randrange(25, 30)}", "kin": lambda: r.choice(_KIN), "home": lambda: r.choice(_HOME), "place": lambda: r.choice(_PLACE), "deva": lambda: self.indic(_DEVA, _DEVA_V).split()[0], "telu": lambda: self.indic(_TELU, _TELU_V).split()[0],
        }
        return made[slot]()


KIND = {"PERSON": "person", "DEVA": "person", "TELU": "person", "PHONE": "phone", "EMAIL": "email", "IDNO": "id_number", "IDBARE": "id_number", "ADDR": "address", "ADES": "address", "ADDE": "address", "ADPT": "address", "ADHI": "address", "ADMR": "address", "ADTE": "address"}


def examples(n: int, seed: int = 11) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str]]:
    """n labelled texts (spans of characters with their kind), and the invented name list."""
    import re

    make = Maker(seed)
    r = make.r
    with_, without = [x for line in WITH.splitlines() for x in line.split("|")], [x for line in WITHOUT.splitlines() for x in line.split("|")]
    slots = re.compile("|".join(sorted({*KIND, "REF"}, key=len, reverse=True)) + "|~(?:num|area|price|loc|projword|proj|name|firmword|bank|word|street|month|day|year|kin|deva|telu|home|place)")
    make.listed.update(w for w in _WORDS if r.random() < 0.7)
    out = []
    with_ += [x for x in with_ if "PHONE" in x] + ["office line PHONE is always busy", "mera number PHONE hai, shaam ko call karna"] + ["PHONE"] * 6 + ["PERSON will come for the site visit", "PERSON here, any update?", "Thanks PERSON", "please speak to PERSON about it"] * 2 + ["this is PERSON\nEMAIL", "regards, PERSON, EMAIL", "agreement will be in the name of PERSON\nEMAIL", "Thanks PERSON\nPHONE", "regards, PERSON, PHONE", "regards, PERSON\nIDNO attached"] + ["IDNO attached", "KYC done, IDNO", "IDNO"] * 2 + ["ADDR", "current address is ADDR", "courier it to ADDR", "we live at ADDR", "pick me up from ADDR on the way"] + ["ADDR, PHONE", "ADDR. PHONE", "ADDR and whatsapp: PHONE"]
    without += [line for lines in SEED.values() for line in lines]
    for k in range(n):
        parts = [with_[k % len(with_)] if k % 2 else without[(k // 2) % len(without)]]
        while r.random() < 0.45 and len(parts) < 3:
            parts.append(r.choice(with_ if r.random() < 0.45 else without))
        r.shuffle(parts)
        text, spans = "", []
        for j, part in enumerate(parts):
            if j:
                text += r.choice([", ", "\n", " - ", " and ", ". ", " / ", " | ", " — ", "? "])
            start, case, pos = len(text), r.random(), 0
            made, own = "", []
            for m in slots.finditer(part):
                made += part[pos : m.start()]
                before, _, value = make.fill(m.group().lstrip("~")).rpartition("\x00")  # a number's keyword isn't labelled
                made += before + " " * bool(before)
                if m.group() in KIND:
                    own.append((len(made), len(made) + len(value), KIND[m.group()]))
                made, pos = made + value, m.end()
            made += part[pos:]
            if case < 0.06:
                made = made.upper() if len(made.upper()) == len(made) else made
            elif case < 0.14:
                made = made[:1].upper() + made[1:]
            if r.random() < 0.2:
                made += r.choice([".", " ok?", " sir", " pls", " ??", " 🙂", "..", " please"])
            text += made
            spans += [(start + a, start + b, kind) for a, b, kind in own]
        out.append((text, spans))
    return out, make.listed
