x384