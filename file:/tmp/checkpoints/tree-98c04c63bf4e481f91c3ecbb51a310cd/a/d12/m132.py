x132