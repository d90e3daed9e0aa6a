x725