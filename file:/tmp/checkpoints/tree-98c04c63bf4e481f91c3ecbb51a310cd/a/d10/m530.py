x530