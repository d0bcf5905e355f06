"""Default stopword lists for Russian news text.

Fixed values: both lists must stay exactly as they are, because cleaning
results depend on every entry. Pass another list to ``clean_text`` for other
languages.
"""

GENERAL = """
и в во не что он на я с со как а то
все она так его но да ты к у же вы за
бы по только ее мне было вот от меня еще
нет о из ему теперь когда даже ну ли если
уже или ни быть был него до вас опять уж
вам ведь там потом себя ей может они тут где
есть надо ней для мы их чем была сам чтоб
без будто чего раз тоже себе под будет тогда
кто этот того потому этого какой совсем ним здесь
этом один почти мой тем чтобы нее сейчас были
куда зачем всех никогда можно при наконец об другой
хоть после над больше тот через эти нас про
всего них какая много разве эту моя впрочем хорошо
свою этой перед иногда лучше чуть том нельзя
такой им более всегда конечно всю между это
""".split()

NEWS = """
год года году лет также время ранее словам
сообщает сообщила сообщили рассказал заявил отметил
добавил уточнил стало стать который которые
новость риа тасс интерфакс
свой новый первый
""".split()

DEFAULT = tuple(dict.fromkeys(GENERAL + NEWS))
