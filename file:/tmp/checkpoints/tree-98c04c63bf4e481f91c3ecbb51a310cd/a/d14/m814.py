x814