"""Texts laid out like tender documents, composed from rows of `orders` by one SQL expression that both engines read.

The test documents hold few of the anchors that the extraction rules read, so the rules run over
these too: complete boxes of characteristics, prose, lettered boxes, thresholds and broken numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.session import table


def _text(es: Callable[[str], str]) -> str:
    k, price = "o_orderkey", "o_totalprice"
    months = f"cast({k} % 36 + 1 as string)"
    yes = f"case when {k} % 3 = 0 then 'SI' else 'NO' end"
    box = f"""concat('PLIEGO', chr(10), 'ANEXO I. CUADRO DE CARACTERÍSTICAS', chr(10), '1) PROCEDIMIENTO Y CALIFICACIÓN DEL CONTRATO PROCEDIMIENTO: ', case when {k} % 5 = 0 then 'ABIERTO SIMPLIFICADO' else 'ABIERTO' end, '. CALIFICACIÓN: Contrato administrativo de ',
      case {k} % 3 when 0 then 'OBRAS' when 1 then 'SERVICIOS' else 'SUMINISTROS' end, ' art. 13.', chr(10), '2) ÓRGANO CONTRATANTE Junta de Obras ', cast({k} % 7 as string), ' Dirección postal: Plaza Mayor', chr(10), '3) TRAMITACIÓN : ', case when {k} % 4 = 0 then 'Urgente' else 'Ordinaria' end, chr(10),
      '4) OBJETO DEL CONTRATO OBRAS DE LA CALLE ', cast({k} as string), '. 5) Otros.', chr(10), '8) PLAZO DE EJECUCIÓN Plazo: ', {months}, ' MESES Contados a partir del acta', chr(10), '10) Total valor estimado contrato : ', {es(price)}, ' € Total Base imponible: ', {es(price)}, ' Importe del 21% de IVA: ', {es(price + ' * 0.21')}, ' € TOTAL: ', {es(price + ' * 1.21')}, ' €', chr(10),
      '14) Solvencia: volumen anual de negocios por importe de ', {es(price)}, ' €. El 70 % ): ', {es(price + ' * 0.7')}, ' euros. Grupo: C) Edificaciones Subgrupo: ', cast({k} % 9 + 1 as string), ' Categoría: 3 Grupo: C) Edificaciones Subgrupo: ', cast({k} % 9 + 1 as string), ' Categoría: 3 Grupo: G Subgrupo: 6 Categoría: 2', chr(10),
      '20) GARANTÍA PROVISIONAL. Procede: ', {yes}, chr(10), '22) GARANTÍA DEFINITIVA. Procede: SI Importe: 5% del importe de adjudicación, IVA excluido. Constitución mediante retención en el precio: ', {yes}, chr(10),
      '24) PÓLIZAS DE SEGUROS Procede: SI. Responsabilidad Civil de construcción: por importe mínimo de ', {es(price)}, ' € por siniestro y año. Póliza de todo riesgo: por un importe de ', {es(price + ' * 2')}, ' € Franquicia admisible en seguro: ', {yes}, chr(10),
      '31) PLAZO DE GARANTÍA: ', cast({k} % 3 + 1 as string), ' AÑOS.', chr(10), '33) LICITACIÓN ELECTRÓNICA: SI OBLIGATORIA', chr(10), '8. PLAZO. Repetido al final', chr(10), 'ANEXO II MODELO', chr(10), '1. NO CUENTA')"""
    prose = f"""concat('Cláusula 3. Régimen del contrato', chr(10), 'La tramitación del expediente es ', case when {k} % 2 = 0 then 'ordinaria' else 'urgente' end, '. El plazo de ejecución será como mínimo de 3 meses. La duración del contrato es de ', {months}, ' meses', chr(10), 'Cláusula 24 - Responsabilidad por daños', chr(10),
      'El valor estimado del contrato asciende a ', {es(price)}, ' euros y el presupuesto base de licitación, IVA incluido, a ', {es(price + ' * 1.21')}, ' €.', chr(10), 'La garantía definitiva del ', cast({k} % 9 + 1 as string), ' % del precio final ofertado. Plazo de garantía mínimo: ', cast({k} % 12 + 1 as string), ' meses.', chr(10), 'Presupuesto roto: 40 .000,00 € y 8 0.000,00 €')"""
    lettered = f"""concat('A. PRESUPUESTO BASE', chr(10), 'B. VALOR ESTIMADO ', {es(price)}, ' €', chr(10), 'C. PLAZO DE GARANTÍA', chr(10), 'D. SOLVENCIA TÉCNICA', chr(10), 'E. OBJETO DEL CONTRATO: SUMINISTRO DE LUMINARIAS PARA EL LOTE ', cast({k} as string), '. ', chr(10), 'CONTRATO DE SERVICIOS PROCEDIMIENTO NEGOCIADO SIN PUBLICIDAD', chr(10), 'ANEXO VII - Modelo de oferta', chr(10), 'Garantía definitiva no inferior al 5 %. Plazo de garantía: según oferta, ', cast({k} % 5 + 1 as string), ' años')"""
    framework = f"""concat('Según el cuadro de características particulares (CCP), el valor estimado sea superior a 15.000,00 €. PLEC DE CLÀUSULES amb aquest contracte, amb dels. Duración del contrato: ', {months}, ' SEMANAS')"""
    return f"case {k} % 4 when 0 then {box} when 1 then {prose} when 2 then {lettered} else {framework} end"


CARRIER_SQL = f"select o_orderkey as doc_id, {_text(lambda x: f"translate(format('{{:,.2f}}', {x}), ',.', '.,')")} as text from orders"


def carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)."""
    text = _text(lambda x: f"translate(format_number({x}, 2), ',.', '.,')")
    # a file of one row group is one task: keys and prices are dealt out before they become texts
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))
