x357