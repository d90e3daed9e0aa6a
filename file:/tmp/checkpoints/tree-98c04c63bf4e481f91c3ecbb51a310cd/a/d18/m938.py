x938