"""The small labelled table that language scores start from: ordinary sentences, written for this purpose."""

SEED = {
    "en": """the house is near the station and the price is too high for us
could you please send me the details of the apartment and the plan
we would like to visit the place on sunday morning with our parents
I have not decided yet because my brother wants to see it first
how much is the rent and what are the other charges each month
is there any problem with water in this area during the summer
thank you for your help, we will call you back later this week
they were not able to come yesterday but they will be here tomorrow
what about the kitchen and the bathroom, are there two of them
this is a good offer but it depends on the bank and on the loan
do you have something cheaper with a small garden and a garage
he said that she had already paid for it when we asked him""",
    "hi": """मुझे यह घर बहुत पसंद आया लेकिन कीमत ज्यादा है
क्या आप कल सुबह मिल सकते हैं और मुझे जानकारी दे सकते हैं
हम लोग अगले हफ्ते वहाँ जाएंगे और फिर फैसला करेंगे
मेरे पिता जी से बात करके आपको बता दूंगा
यहाँ पानी और बिजली की कोई दिक्कत तो नहीं होती
बैंक का लोन कब तक मिल जाएगा यह नहीं पता
उसने कहा था कि वह आज नहीं आएगा
mujhe yeh ghar bahut pasand hai lekin daam zyada hai
kya aap kal subah mil sakte hain aur humko batao
hum log agle hafte wahan jayenge phir bata denge
mere papa se baat karke aapko bataunga abhi nahi
kab tak ho jayega kaam aur kitna paisa lagega
nahi chahiye bhai thoda kam karo na warna rehne do
woh log kal aaye the par kuch bola nahi""",
    "mr": """मला हे घर खूप आवडलं पण किंमत जास्त आहे
तुम्ही उद्या सकाळी भेटू शकता का आणि मला माहिती द्याल का
आम्ही पुढच्या आठवड्यात तिथे जाणार आहोत आणि मग ठरवू
माझ्या वडिलांशी बोलून तुम्हाला सांगतो
इथे पाणी आणि वीज यांची काही अडचण नाही ना
बँकेचं कर्ज कधी मिळेल ते माहीत नाही
तो म्हणाला की आज येणार नाही
आमच्या घरात चार माणसं आहेत त्यामुळे मोठी जागा हवी""",
    "te": """నాకు ఈ ఇల్లు చాలా నచ్చింది కానీ ధర ఎక్కువ
మీరు రేపు ఉదయం కలవగలరా నాకు వివరాలు చెప్పండి
మేము వచ్చే వారం అక్కడికి వెళ్తాము తర్వాత చెప్తాము
మా నాన్నగారితో మాట్లాడి మీకు చెప్తాను
ఇక్కడ నీళ్ళు కరెంటు సమస్య లేదు కదా
బ్యాంకు లోన్ ఎప్పుడు వస్తుందో తెలియదు""",
    "es": """la casa está cerca de la estación y el precio es demasiado alto para nosotros
¿podría usted enviarme los detalles del piso y el plano por favor?
queremos visitar el lugar el domingo por la mañana con mis padres
todavía no lo he decidido porque mi hermano quiere verlo primero
¿cuánto cuesta el alquiler y qué otros gastos hay cada mes?
hay algún problema con el agua en esta zona durante el verano
muchas gracias por su ayuda, le llamaremos más tarde esta semana
ellos no pudieron venir ayer pero estarán aquí mañana
me gusta mucho pero depende del banco y de la hipoteca
tengo que hablar con mi mujer, ¿tienen algo más barato con jardín?
él dijo que ella ya lo había pagado cuando le preguntamos""",
    "pt": """a casa fica perto da estação e o preço é demasiado alto para nós
podia enviar-me os detalhes do apartamento e a planta por favor?
queremos visitar o lugar no domingo de manhã com os meus pais
ainda não decidi porque o meu irmão quer ver primeiro
quanto custa a renda e quais são as outras despesas por mês?
há algum problema com a água nesta zona durante o verão
muito obrigado pela sua ajuda, ligamos mais tarde esta semana
eles não puderam vir ontem mas estarão aqui amanhã
gosto muito mas depende do banco e do crédito
tenho de falar com a minha mulher, vocês têm algo mais barato com jardim?
ele disse que ela já tinha pago quando lhe perguntámos""",
    "de": """das Haus liegt in der Nähe vom Bahnhof und der Preis ist zu hoch für uns
könnten Sie mir bitte die Unterlagen zur Wohnung und den Plan schicken?
wir möchten am Sonntag Vormittag mit meinen Eltern vorbeikommen
ich habe mich noch nicht entschieden, weil mein Bruder sie zuerst sehen will
wie hoch ist die Miete und welche Kosten kommen jeden Monat dazu?
gibt es in dieser Gegend im Sommer ein Problem mit dem Wasser
vielen Dank für Ihre Hilfe, wir rufen Sie später diese Woche an
sie konnten gestern nicht kommen, aber morgen sind sie hier
es gefällt uns gut, aber das hängt von der Bank und vom Kredit ab
ich muss mit meiner Frau sprechen, haben Sie etwas Günstigeres mit Garten?
er sagte, dass sie schon bezahlt hatte, als wir ihn fragten""",
}
SEED = {lang: lines.splitlines() for lang, lines in SEED.items()}
