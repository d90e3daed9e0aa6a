x319