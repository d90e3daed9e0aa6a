x346