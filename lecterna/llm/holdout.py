"""Hand-checked texts on which the kind model's probabilities are calibrated.

Written for this purpose, one by one, in several languages; kinds by eye.
"""

HOLDOUT: list[tuple[str, str]] = [
    ("prose", "The tide was out when we reached the pier. Nobody had brought a torch, so we waited."),
    ("prose", "we walked to the old mill\nit had stopped turning years ago\nsomebody still swept the floor"),
    ("prose", "我们昨天去了博物馆。讲解员说得很慢，大家都听懂了。"),
    ("prose", "他把伞忘在车上了 后来雨停了 我们就走回去了"),
    ("prose", "先生が来る前に、窓を開けました。風が少し冷たかったです。"),
    ("prose", "학생들은 운동장에서 기다렸습니다. 비가 곧 그쳤습니다."),
    ("prose", "Der Zug kam zu spät, deshalb haben wir den Anschluss verpasst. Am Abend waren wir müde."),
    ("prose", "La pluie a cessé vers midi. Les enfants sont sortis jouer dans la cour."),
    ("prose", "¿Quién cerró la puerta? Yo creo que fue el viento."),
    ("prose", "Anna: Did you read the chapter?\nBen: Only the first half. It was long.\nAnna: We can finish it together."),
    ("prose", "Bring these things to the trip and leave the rest at home:\n- a hat\n- water\nWe start early because the road is long, and the bus will not wait for anybody who is late."),
    ("prose", "Morning notes\n\nThe bell rang twice. After that the class became quiet and the reading went on without a break."),
    ("prose", "好的。"),
    ("prose", "I don't know."),
    ("prose", "เมื่อวานฝนตกหนัก เราเลยไม่ได้ไปตลาด"),
    ("prose", "كان الجو باردا في الصباح. ذهبنا إلى المدرسة سيرا على الأقدام."),
    ("prose", "कल बहुत गरमी थी। हम शाम को नदी तक गए।"),
    ("prose", "the lamp went out and we could not\nfind the switch so my sister lit a\ncandle and told us about the winter\nshe spent at the lake"),
    ("list", "- bread\n- two lemons\n- olive oil\n- salt"),
    ("list", "1. open water\n2. deep wells\n3. rain barrels\n4. melted snow"),
    ("list", "copper; tin; zinc; lead; silver; nickel"),
    ("list", "铅笔\n橡皮\n尺子\n圆规\n笔记本"),
    ("list", "苹果、梨、桃子、葡萄、西瓜、樱桃"),
    ("list", "harbour — 港口\nbridge — 桥\nriver mouth — 河口\nlighthouse — 灯塔"),
    ("list", "Things to pack:\nwarm socks\na small knife\nspare laces\nthe green tent\na whistle\na map"),
    ("list", "1 Birds\n  a) owls\n  b) herons\n2 Fish\n  a) trout\n  b) pike"),
    ("list", "• el perro\n• la casa azul\n• un barco viejo"),
    ("list", "(1) 운동장\n(2) 도서관\n(3) 급식실\n(4) 음악실"),
    ("list", "えんぴつ、けしごむ、ノート、じょうぎ、はさみ"),
    ("list", "der Apfel, die Birne, das Brot, der Käse, die Milch"),
    ("list", "velocity (12), mass (30), inertia (31), impulse (44), torque (52)"),
    ("list", "oak / ash / birch / lime tree / maple"),
    ("table", "name,age,town\nMira,12,Aral\nTom,13,Brenn\nLu,12,Cardo"),
    ("table", "| day | high | low |\n|---|---|---|\n| Mon | 14 | 6 |\n| Tue | 11 | 4 |"),
    ("table", "08:00\t08:45\tmaths\n08:50\t09:35\tmusic\n10:00\t10:45\tsport"),
    ("table", "<tr><td>A</td><td>4.5</td></tr>\n<tr><td>B</td><td>3.9</td></tr>\n<tr><td>C</td><td>7.0</td></tr>"),
    ("table", "姓名;分数;班级\n小王;88;三班\n小李;92;一班\n小赵;79;二班"),
    ("table", "item        price   stock\nred cup      3.20      14\nblue plate   5.00       2\nspoon        1.10     120"),
    ("table", '"We left at noon";"12:00";"4"\n"Nobody answered the door";"12:20";"7"\n"The shop was closed";"12:45";"2"'),
    ("table", "Results of the second round are below.\n1 | 44 | 12:01\n2 | 39 | 12:09\n3 | 41 | 12:15\n4 | 37 | 12:30"),
    ("junk", "@@# ~~ %% ^& *( ]] |\\ ## ~~ @! %% &&"),
    ("junk", "xkqv ptzr wlmm bqd jjzx kfrw qpv zzt mwrk"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgcmVhZGFibGU0NTY3ODkwYWJjZGVm"),
    ("junk", "the th the th the th the th the th the th the th the th"),
    ("junk", "Ã©tÃ© dâ€™hiver Ã  cÃ´tÃ© de lâ€™Ã©glise dÃ©jÃ  fermÃ©e"),
    ("junk", "哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈哈"),
    ("junk", "e a otrn siht lde gnr aeo wth uio rsn tle daeh osi"),
    ("junk", "丨一丿口乀_|~ 亅 l1I| 凵_一 |丨口 ~~ 丿l"),
]
