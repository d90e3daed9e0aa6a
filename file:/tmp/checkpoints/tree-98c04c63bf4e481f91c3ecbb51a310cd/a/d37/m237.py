x237