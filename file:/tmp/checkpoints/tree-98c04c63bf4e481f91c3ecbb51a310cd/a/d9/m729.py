x729