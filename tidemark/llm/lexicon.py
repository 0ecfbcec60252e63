"""Word lists of the content classifier, by what a word does, over the languages of the corpus."""

# Words that insult a person.
INSULTS = """
idiot idiots moron morons asshole scumbag bitch bastard loser clown imbecile parasite cretin dumbass retard dickhead prick wanker
jerk fatso pig cow stupid brainless braindead pathetic worthless disgusting useless filthy ugly ashamed trash waste
idiota imbecil imbécil gilipollas payaso cabron cabrón pendejo estupido estúpido asqueroso asco inutil inútil hijoputa basura cojones huevos
connard connasse abruti conne crétin cretin débile ordure merde enfoiré salope sale dégage pouffiasse
arschloch wichser idiot depp vollidiot hurensohn drecksau schlampe fresse missgeburt dreckiges dreckiger spast
stronzo coglione deficiente bastardo cretino scemo schifo testa cazzo imbecille
babaca otario otário desgraçado desgracado nojento burro imbecil cuzao cuzão arrombado
goblok tolol bangsat bajingan anjing brengsek kampret bodoh monyet babi
harami kutta kutte kamina kamine bewakoof gadha gadhe chutiya saala कुत्ते कुत्ता कमीने कमीना हरामी बेवकूफ गधे गधा चूतिया साले
ควาย ไอ้โง่ ไอ้เหี้ย เหี้ย สัตว์ อีดอก ไอ้สัตว์ ไอ้ควาย โง่
"""
# Words of threats and wishes of death or harm.
THREATS = """
kill die dead drown drowned hang choke rot burn burns beating beat break teeth ditch crawl hole skin disappeared shut mouth hurt stab
muere mueras muérete muerete matar mato matare morir vete crever crève creve mourir buter tuer gueule verreck stirb umbringen töten schlag
crepa crepare muoia muori ammazzo ammazzati morra morrer morre matar mati mampus bunuh mar maar मर मरो मार ตาย ฆ่า
yourself ojalá ojala spero tomara espère espere hoffentlich semoga
"""
# Words that belittle or attack a group.
DEHUMANISE = """
vermin rats cockroaches cattle goats animals filth subhuman thieves parasites scum dirty breed race blood whores inferior burden disease plague
ratas basura raza plaga sucios vermine parasites race rats saleté cafards ungeziefer pack ratten abschaum dreck
feccia ratti razza parassiti scarafaggi lixo ratos raça raca praga sampah tikus hama kecoa gandagi keede kachra कचरा कीड़े गंदगी चूहे ขยะ หนู สวะ
"""
# Words for driving a group out or denying it rights.
EXPEL = """
coffins ban expel deport beaten slapped belongs deserve kitchen allowed finished invaders back treated steal
echarlos larguen expulsarlos fuera chasse chasser retournez dehors verjagen raus rauswerfen abschieben cacciarli cacciare fuori
expulsos expulsar fora usir diusir bhagao nikalo भगाओ निकालो भगा निकाल ไล่ ออกไป
"""
# Words for groups of people by faith, sex, orientation, age, looks or disability.
GROUPS = """
women woman females gays gay lesbians jews muslims immigrants foreigners foreign disabled blacks dark-skinned skinned refugees hindus christians buddhists
mujeres maricones gitanos negros moros inmigrantes discapacitados femmes pédés pedes arabes étrangers etrangers handicapés juifs
frauen schwule ausländer auslander behinderte juden donne froci negri stranieri disabili mulheres gays pretos estrangeiros deficientes
perempuan wanita orang asing cacat auratein musalman videshi औरतें औरतों मुसलमान विदेशी คนต่างชาติ ผู้หญิง เกย์
"""
# Explicit sexual words.
SEXUAL = """
fuck fucking cock dick pussy tits boobs blowjob handjob horny nudes porn cum cumming orgasm dildo jerking hard-on hardon hardcore masturbate
milf slut anal follan follar follo coño tetas cachondo cachonda mamada
baisent baiser chatte nichons branler bander salope ficken fickt fick schwanz fotze titten geil nacktbilder wichsen muschi
scopano scopare figa arrapato arrapata pompino scopata trepam trepar foder buceta tesão punheta
ngentot kontol memek bugil ngewe bokep
chudai chodna chodo lund chut हवस चुदाई लंड चूत नंगी เย็ด ควย เงี่ยน โป๊ เสียว หี
"""
# Words that are sexual in company only.
SUGGESTIVE = """
sex sexe sexo sesso naked nude nuda nue topless uncensored uncut strip wet suck lick bend massage desnuda desnudo pelada nackt
polla bite queue pau peitos suce telanjang nange nangi nanga नंगे सेक्स เปลือย นม
"""
# Words that address someone.
ADDRESS = """
you your yourself u tu te ti tus eres vete cállate callate toi ton ta tes t'es ferme va du dich dir dein deine bist halt sei tuo tua mandami
você voce seu sua vai cala manda kamu lo lu elu kau mu tum tu tera teri tujhe तू तुम तेरी तेरा तुझे मुंह แก มึง เธอ
me message send mándame mandame envoie schick kirim bhejo भेजो ส่ง
"""

GROUPS_OF_WORDS = {
    "insult": INSULTS, "threat": THREATS, "dehumanise": DEHUMANISE, "expel": EXPEL, "group": GROUPS, "sexual": SEXUAL, "suggest": SUGGESTIVE, "address": ADDRESS,
}

# Letters of other scripts that look like Latin ones, and signs put for letters.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁгпкмтвɡοαερικνυ", "aeopcyxisjhdrnkmtbgoaepiknu")
SIGNS = str.maketrans("@$013457!|8", "asoieastiib")
