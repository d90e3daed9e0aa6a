x211